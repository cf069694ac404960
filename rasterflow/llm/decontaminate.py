"""Benchmark decontamination by a generalised suffix automaton over the words of the test items."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterflow.llm.common import filesystem, materialize, tuned

#: A to Z to lower case; every byte that can't be in a word to a space. Bytes from 0x80 are parts of words.
NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
WINDOW = 13
#: Words of items that one automaton holds: bounds what a worker needs while it builds one.
BLOCK_WORDS = 250_000


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(NORMAL).split()


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences; tells which windows of the items end at each word.

    Built with a dictionary for each state, then kept in arrays: most states have one transition.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.words: dict[bytes, int] = {}
        self.items = [i for i, _ in items]
        nxt: list[dict[int, int]] = [{}]
        link, length = [-1], [0]
        ends: dict[int, set[int]] = {}
        short: dict[int, dict[int, set[int]]] = {}
        for item, (_, seq) in enumerate(items):
            last = 0
            for w in seq:
                last = self._extend(nxt, link, length, last, self.words.setdefault(w, len(self.words)))
                if length[last] >= window:
                    ends.setdefault(last, set()).add(item)
            if seq and len(seq) < window:
                short.setdefault(last, {}).setdefault(len(seq), set()).add(item)
        self.link, self.length = array("i", link), array("i", length)
        #: The word and target of states with one transition; transitions of the others.
        self.word, self.target = array("i", [-1]) * len(nxt), array("i", [0]) * len(nxt)
        self.several: dict[int, dict[int, int]] = {}
        for state, to in enumerate(nxt):
            if len(to) == 1:
                self.word[state], self.target[state] = next(iter(to.items()))
            elif to:
                self.several[state] = to
            nxt[state] = None
        order = sorted(range(1, len(link)), key=length.__getitem__)
        for s in reversed(order):
            if link[s] > 0 and length[link[s]] >= window and s in ends:
                ends[link[s]] = ends.get(link[s], set()) | ends[s]
        #: Items in which the longest suffix of at least window words occurs, by number; equal sets are held once.
        self.sets: list[tuple[int, ...]] = [()]
        known: dict[tuple[int, ...], int] = {(): 0}
        self.whole = array("i", [0]) * len(link)
        #: Short items that end here: (words, items), along the suffix links.
        self.short: dict[int, tuple[tuple[int, tuple[int, ...]], ...]] = {}
        for s in order:
            own = tuple((k, tuple(sorted(v))) for k, v in short[s].items()) if s in short else ()
            if got := own + self.short.get(link[s], ()):
                self.short[s] = got
            if length[s] >= window:
                # the state whose strings include the one of exactly `window` words
                up = link[s]
                if length[up] >= window:
                    self.whole[s] = self.whole[up]
                else:
                    which = tuple(sorted(ends.get(s, ())))
                    if which not in known:
                        known[which] = len(self.sets)
                        self.sets.append(which)
                    self.whole[s] = known[which]

    @staticmethod
    def _extend(nxt: list, link: list, length: list, last: int, w: int) -> int:
        def clone(p: int, q: int) -> int:
            new = len(nxt)
            nxt.append(dict(nxt[q]))
            link.append(link[q])
            length.append(length[p] + 1)
            link[q] = new
            while p != -1 and nxt[p].get(w) == q:
                nxt[p][w] = new
                p = link[p]
            return new

        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else clone(last, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else clone(p, q)
        return cur

    def hits(self, seq: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Maximal runs [start, end) of words inside occurring windows, and the items whose windows occur."""
        word, target, several, link, length, window, whole, short = self.word, self.target, self.several, self.link, self.length, self.window, self.whole, self.short
        runs: list[list[int]] = []
        items: set[int] = set()
        state, matched = 0, 0
        for at, w in enumerate(map(self.words.get, seq)):
            if w is None:
                state = matched = 0
                continue
            while True:
                if word[state] == w:
                    state = target[state]
                    matched += 1
                    break
                to = several.get(state)
                if to is not None and w in to:
                    state = to[w]
                    matched += 1
                    break
                if not state:
                    break
                state = link[state]
                matched = length[state]
            longest = 0
            if matched >= window:
                items.update(self.sets[whole[state]])
                longest = window
            if state in short:
                for k, which in short[state]:
                    if k <= matched:
                        items.update(which)
                        longest = max(longest, k)
            if longest:
                begin = at + 1 - longest
                while runs and runs[-1][0] >= begin:
                    runs.pop()
                if runs and runs[-1][1] >= begin:
                    runs[-1][1] = at + 1
                else:
                    runs.append([begin, at + 1])
        return runs, {self.items[i] for i in items}


@lru_cache(maxsize=2)
def automata(path: str, window: int, block_words: int) -> list[SuffixAutomaton]:
    """The automata of a written benchmark, of at most block_words words each: built once in a worker, for all its tasks."""
    fs, at = filesystem(path)
    out, held, room = [], [], block_words
    for batch in ds.dataset(at, format="parquet", filesystem=fs).to_batches(batch_size=1024):
        for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if not (seq := words(text)):
                continue
            if len(seq) > room and held:
                out.append(SuffixAutomaton(held, window))
                held, room = [], block_words
            held.append((item, seq))
            room -= len(seq)
    return [*out, SuffixAutomaton(held, window)] if held else out


def written(benchmark: DataFrame) -> str:
    """The path of the benchmark's items in the shared folder: workers read them there, the driver doesn't."""
    rows = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    return materialize(rows, "benchmark").stored_at


def match_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, hit_runs (array of word runs) and hit_items (as strings) of docs (doc_id, text; others are ignored).

    Documents are only streamed: no shuffle. A benchmark over block_words words is held as several automata, built one
    after the other; a worker holds all of them, in arrays. Null texts have no words; items without words or id match
    nothing; an empty benchmark gives no hits. Repeated documents each get their row.
    """
    tuned(docs.sparkSession)
    path = written(benchmark)
    found = "n_words long, hit_runs array<struct<start:long,end:long>>, hit_items array<string>"
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = automata(path, window, block_words)
        for b in batches:
            n, all_runs, all_items = [], [], []
            for text in b.column("text").to_pylist():
                seq = words(text)
                got = [a.hits(seq) for a in held]
                n.append(len(seq))
                all_runs.append(merged([r for runs, _ in got for r in runs]))
                all_items.append(sorted(set().union(*(items for _, items in got))))
            made = {"n_words": pa.array(n, pa.int64()), "hit_runs": pa.array(all_runs, run_type), "hit_items": pa.array(all_items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id").cast(pa.int64())} | made)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {found}")


def merged(runs: list[list[int]]) -> list[dict]:
    out: list[dict] = []
    for s, e in sorted(runs):
        if out and s <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], e)
        else:
            out.append({"start": s, "end": e})
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated (at least a twentieth of the words is hit).

    items_sha256 is of the empty string where nothing occurs.
    """
    hit = F.aggregate("hit_runs", F.lit(0).cast("long"), lambda s, r: s + r["end"] - r["start"])
    return (
        match_benchmark(docs, benchmark, window, block_words)
        .select("doc_id", "n_words", hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), "hit_items")
        .select(
            "doc_id", "n_words", "n_hit", "n_items",
            F.sha2(F.array_join(F.array_sort("hit_items"), ","), 256).alias("items_sha256"),
            ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        )
    )


def remove_spans(docs: DataFrame, benchmark: DataFrame, max_words: int = 50, window: int = WINDOW) -> DataFrame:
    """docs without contaminated documents; in the others, hit runs of over max_words words are cut out of the text.

    The rest of a text stays as it is, byte for byte; of other columns only n_chars, if there is one, follows the new text. Null texts stay null.
    """
    tuned(docs.sparkSession)
    names = docs.columns
    path = written(benchmark)
    arrow_schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        word = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
        held = automata(path, window, BLOCK_WORDS)
        for b in batches:
            at = b.schema.get_field_index("text")
            texts, keep = b.column(at).to_pylist(), []
            for k, text in enumerate(texts):
                seq = words(text)
                runs = merged([r for a in held for r in a.hits(seq)[0]])
                n_hit = sum(r["end"] - r["start"] for r in runs)
                keep.append(not (n_hit and 20 * n_hit >= len(seq)))
                long = [r for r in runs if r["end"] - r["start"] > max_words]
                if keep[-1] and long:
                    raw = text.encode()
                    spans = [m.span() for m in word.finditer(raw)]
                    for r in reversed(long):
                        raw = raw[: spans[r["start"]][0]] + raw[spans[r["end"] - 1][1] :]
                    texts[k] = raw.decode()
            columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(b.columns)]
            if "n_chars" in names:
                k = b.schema.get_field_index("n_chars")
                counts = zip(columns[k].to_pylist(), b.column(at).to_pylist(), texts, strict=True)
                columns[k] = pa.array([n if t is s or t == s else len(s) for n, t, s in counts], columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))

    return docs.mapInArrow(run, arrow_schema)
