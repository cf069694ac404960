"""Exact removal of repeated byte strings by prefix-free parsing.

Triggers are the k-grams whose rolling hash is the smallest in a window of a repeat's length, so every string of
that length holds one, chosen by its own bytes alone. The windows that share a trigger make a phrase, overlapping
its neighbours by a window less a byte: each window lies in one phrase. The dictionary holds each phrase once, the parse
names the phrases of each document, by the hash of the trigger and another of the phrase, 128 bits together.

Windows are ordered by the dictionary's suffixes, and the parse gives how often each phrase's windows stand in the corpus: a
phrase that it holds twice is repeated as a whole, and only phrases that share a trigger with others are sorted.
Aligned at the trigger, their rows are kept in the order of their suffixes column by column from right to left (a
positional suffix array), and neighbours whose common prefix is a repeat's length are repeats. Triggers of very many
phrases are split first, by the bytes beside the trigger that half of the windows have, and again, until few are left.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterflow.llm.common import discard, materialize, release, tuned
from rasterflow.llm.pair_search import scramble as mixed

LENGTH, GRAM = 400, 100
#: Bytes that are hashed at once: bounds a worker's memory. Positions within a slice fit in 21 bits.
SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of bytes; powers of the base and of its inverse, modulo 2^64."""
    n = SLICE + 4 * LENGTH + 1
    values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    power, inverse = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    power[0] = inverse[0] = 1
    return values, np.multiply.accumulate(power), np.multiply.accumulate(inverse)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each stretch of width values: running minima from both sides of blocks."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def phrases(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Phrases of documents data[begin:end]: trigger hash, phrase hash, document, first window, windows, trigger offset.

    data has at most SLICE + length bytes. A phrase of w windows covers w + length - 1 bytes from its first window.
    """
    empty = np.empty(0, np.int64)
    if len(data) < length:
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty, empty
    values, power, inverse = _tables()
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values[data] * power[:n], out=sums[1:])
    grams = mixed((sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1])
    mask = np.uint64((1 << 21) - 1)
    packed = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64)
    trigger = (_least(packed, length - gram + 1) & mask).astype(np.int64)
    # windows lie within one document
    valid = np.zeros(len(trigger) + 1, np.int8)
    ok = ends - begins >= length
    np.add.at(valid, begins[ok], 1)
    np.add.at(valid, np.minimum(ends[ok] - length + 1, len(trigger)), -1)
    valid = np.cumsum(valid[:-1]) > 0
    new = valid.copy()
    new[1:] &= (trigger[1:] != trigger[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new)
    doc = np.searchsorted(begins, first, side="right") - 1
    last = np.minimum(np.append(first[1:], len(trigger)), ends[doc] - length + 1)
    width = last - first
    offset = trigger[first] - first
    raw, digest = memoryview(data), xxhash.xxh3_64_intdigest
    whole = np.fromiter((digest(raw[a:z]) for a, z in zip(first.tolist(), (last - 1 + length).tolist(), strict=True)), np.uint64, len(first))
    shape = (offset * 4096 + width).astype(np.uint64)
    return grams[trigger[first]], mixed(whole + mixed(shape)), doc, first, width, offset


def _slices(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Whole texts as slices of bounded size: bytes, begins, ends, which text, where in it. Long texts give several."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def out():
        ends = np.cumsum([len(x) for _, _, x in held])
        begins = ends - [len(x) for _, _, x in held]
        return np.frombuffer(b"".join(x for _, _, x in held), np.uint8), begins, ends, np.array([k for k, _, _ in held]), np.array([a for _, a, _ in held])

    for k, text in enumerate(texts):
        if len(text) < length:
            continue
        for at in range(0, len(text) - length + 1, SLICE):
            part = text[at : at + SLICE + length - 1]
            if size + len(part) > SLICE + length and held:
                yield out()
                held, size = [], 0
            held.append((k, at, part))
            size += len(part)
    if held:
        yield out()


def _phrase_rows(docs: DataFrame, units: Callable, length: int, gram: int) -> DataFrame:
    """tau, f, doc_id, mark and place (first window, windows, trigger offset) of every phrase of units(text). A narrow map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id")
            marks = b.column("mark").to_numpy(zero_copy_only=False)
            texts = [units(t or b"") for t in b.column("text").to_pylist()]
            for data, begins, ends, which, at in _slices(texts, length):
                tau, f, doc, first, width, offset = phrases(data, begins, ends, length, gram)
                k = which[doc]
                place = (first - begins[doc] + at[doc]) << 20 | width << 10 | offset
                yield pa.RecordBatch.from_pydict({
                    "tau": pa.array(tau.view(np.int64)), "f": pa.array(f.view(np.int64)), "doc_id": ids.take(pa.array(k)), "mark": pa.array(marks[k]), "place": pa.array(place),
                })

    return docs.mapInArrow(run, "tau long, f long, doc_id long, mark long, place long")


def repeated_windows(rows: np.ndarray, groups: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Where a row's string of `length` bytes from a column on stands in the same column of another row of its group.

    rows: aligned bytes, 256 where a row has none; groups: sorted. Columns go from right to left, keeping all rows
    in the order of their suffixes (a positional suffix array) with the common prefixes of neighbours.
    """
    n, columns = rows.shape
    order = np.arange(n)
    common = np.zeros(n + 1, np.int64)
    out = np.zeros((n, columns), bool)
    held = groups.astype(np.int64) * 512
    for c in range(columns - 1, -1, -1):
        key = held[order] + rows[order, c]
        moved = np.argsort(key, kind="stable")
        sorted_key = key[moved]
        same = np.zeros(n, bool)
        same[1:] = sorted_key[1:] == sorted_key[:-1]
        same &= sorted_key % 512 != 256
        at = np.flatnonzero(same)
        new = np.zeros(n + 1, np.int64)
        if len(at):
            # neighbours now had between them, before, the least common prefix of all that lay between
            spans = np.column_stack([moved[at - 1] + 1, moved[at] + 1]).ravel()
            new[at] = np.minimum(np.minimum.reduceat(common, spans)[::2] + 1, length)
        order, common = order[moved], new
        full = common >= length
        out[order, c] = full[:-1] | full[1:]
    return out


def _solved(contents: DataFrame, length: int, gram: int) -> DataFrame:
    """doc_id, mark, begin, end: repeated strings of phrases that the parse holds once (contents: few per trigger)."""
    most = length - gram  # a trigger is at most that far after a phrase's first byte

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        grid = np.full((len(rows), 2 * most + length + 1), 256, np.int64)
        names = {}
        groups = np.array([names.setdefault(r[0], len(names)) for r in rows])
        for i, (_, _, _, _, place, _, body) in enumerate(rows):
            start = most - (place & 1023)
            grid[i, start : start + len(body)] = np.frombuffer(body, np.uint8)
        hits = repeated_windows(grid, groups, length)
        out = []
        for i, (_, _, doc_id, mark, place, m, _) in enumerate(rows):
            if m == 1 and hits[i].any():
                begin = (place >> 20) - most + (place & 1023)
                at = np.flatnonzero(hits[i])
                for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
                    out.append((doc_id, mark, begin + int(run[0]), begin + int(run[-1]) + length))
        return _batch(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if len(held) >= 3000 and row[0] != held[-1][0]:
                    yield solve(held)
                    held = []
                held.append(row)
        if held:
            yield solve(held)

    few = contents.repartition("tau").sortWithinPartitions("tau").select("tau", "f", "doc_id", "mark", "place", "m", "body")
    return few.mapInArrow(run, _SPANS)


_SPANS = "doc_id long, mark long, begin long, end long"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 4
    return pa.RecordBatch.from_pydict({n: pa.array(c, pa.int64()) for n, c in zip(("doc_id", "mark", "begin", "end"), columns, strict=True)})


def _split(contents: DataFrame, hot: int, length: int, gram: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Contents of triggers with more than `hot` phrases as contents of smaller groups, and spans that are known on the way.

    A window has between 0 and length - gram bytes before its trigger. Each round halves that range: a phrase gives a row for
    each half in which it has windows, grouped by the bytes that all windows of the half have. A group of one has no repeat; in
    a group of equal rows, as the windows of one size are at last, all windows are repeats.
    """
    names = ["tau", "f", "doc_id", "mark", "place", "m", "body", "low", "high"]

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for tau, f, doc_id, mark, place, m, body, low, high in zip(*(b.column(n).to_pylist() for n in names), strict=True):
                first, width, offset = place >> 20, place >> 10 & 1023, place & 1023
                mid = (low + high) // 2
                for least, most in ((low, mid), (mid + 1, high)):
                    a, z = max(least, offset - width + 1), min(most, offset)
                    if a > z:
                        continue
                    core = body[offset - least : offset + length - most]
                    part = body[offset - z : offset - a + length]
                    group = xxhash.xxh3_64_intdigest(struct.pack("<qqq", tau, least, most) + core) - (1 << 63)
                    whole = xxhash.xxh3_64_intdigest(struct.pack("<qq", a, z) + part) - (1 << 63)
                    out.append((group, f, doc_id, mark, (first + offset - z) << 20 | (z - a + 1) << 10 | z, m, part, least, most, whole))
            columns = list(zip(*out, strict=True)) if out else [()] * 10
            kinds = [pa.int64()] * 6 + [pa.binary()] + [pa.int64()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[*names, "whole"])

    schema = "tau long, f long, doc_id long, mark long, place long, m long, body binary, low long, high long, whole long"
    rows = contents.select(*names[:7], F.lit(0).cast("long").alias("low"), F.lit(length - gram).cast("long").alias("high"))
    few = spans = None
    while rows.limit(1).count():
        cut = materialize(rows.repartition("tau", "f").mapInArrow(halves, schema), "prefix-free-halves")
        groups = materialize(cut.groupBy("tau").agg(F.count("*").alias("n"), F.min("whole").alias("w0"), F.max("whole").alias("w1")).where("n > 1"), "prefix-free-groups")
        known = cut.join(groups, "tau")
        same = known.where("w0 = w1 and m = 1").selectExpr("doc_id", "mark", "shiftright(place, 20) as begin", "shiftright(place, 20) + length(body) as end")
        small = known.where(f"w0 <> w1 and n <= {hot}").select(*names[:7])
        spans = same if spans is None else spans.unionByName(same)
        few = small if few is None else few.unionByName(small)
        rows = known.where(f"w0 <> w1 and n > {hot}").select(*names)
    return few, spans


def _removal(raw: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, int, str]:
    """n_bytes, n_removed, n_spans and the digest of what stays."""
    digest, at, removed, runs = hashlib.sha256(), 0, 0, 0
    for begin, end in _joined(spans):
        digest.update(raw[at:begin])
        removed, runs, at = removed + end - begin, runs + 1, end
    digest.update(raw[at:])
    return len(raw), removed, runs, digest.hexdigest()


def _joined(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return out


_RESULT = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]


def _found(docs: DataFrame, units: Callable, length: int, gram: int, label: str) -> DataFrame:
    """doc_id, mark and p (place, m, c, tau, f) of phrases that the parse holds twice (m > 1) or whose trigger has others (c > 1)."""
    parse = _phrase_rows(docs, units, length, gram)
    dictionary = materialize(parse.groupBy("tau", "f").agg(F.count("*").alias("m")), f"{label}-dictionary")
    by_trigger = dictionary.groupBy("tau").agg(F.count("*").alias("c"), F.min("m").alias("least"), F.max("m").alias("most")).where("c > 1 or most > 1")
    # phrases to remove (m > 1), and those to compare (c > 1, unless all are held twice)
    wanted = dictionary.join(by_trigger, "tau").where("m > 1 or c > 1").selectExpr("tau", "f", "m", "if(c > 1 and least = 1, c, 0L) as c")
    wanted = materialize(wanted, f"{label}-wanted")
    discard(dictionary)
    release(docs.sparkSession)
    return parse.join(wanted, ["tau", "f"]).select("doc_id", "mark", F.struct("place", "m", "c", "tau", "f").alias("p"))


def _spans(contents: DataFrame, hot: int, length: int, gram: int) -> DataFrame:
    """doc_id, mark, begin, end of repeats in phrases that the parse holds once, from contents of all phrases of their triggers."""
    held = contents.where("m = 1").unionByName(contents.where("m > 1").dropDuplicates(["tau", "f"])).select("tau", "f", "doc_id", "mark", "place", "m", "body", "c")
    few, known = _split(held.where(F.col("c") > hot), hot, length, gram)
    small = held.where(F.col("c") <= hot).drop("c")
    spans = _solved(small if few is None else small.unionByName(few), length, gram)
    return spans if known is None else spans.unionByName(known)


def _with_phrases(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """docs with p, the list of their phrases in found."""
    left, right = docs.alias("d"), found.groupBy("doc_id", "mark").agg(F.collect_list("p").alias("p")).alias("p")
    same = F.col("d.mark").eqNullSafe(F.col("p.mark")) & F.col("d.doc_id").eqNullSafe(F.col("p.doc_id"))
    return left.join(right, same, how).select("d.doc_id", "d.mark", "d.text", "p.p")


def _place(x: dict, length: int) -> tuple[int, int]:
    """Begin and end of a phrase."""
    return x["place"] >> 20, (x["place"] >> 20) + (x["place"] >> 10 & 1023) + length - 1


def _report(docs: DataFrame, hot: int, length: int, gram: int) -> DataFrame:
    """doc_id, mark, n_bytes, n_removed, n_spans and kept_sha256 of every row of docs (doc_id, mark, text as bytes)."""
    found = _found(docs, bytes, length, gram, "prefix-free")

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """kind 0: results; 1: contents of phrases to compare; 2: texts that wait for them, with their spans so far."""
        for b in batches:
            out = []
            for doc_id, mark, raw, p in zip(*(b.column(n).to_pylist() for n in ("doc_id", "mark", "text", "p")), strict=True):
                raw, p = raw or b"", p or []
                spans = _joined([_place(x, length) for x in p if x["m"] > 1])
                for x in p:
                    if x["c"]:
                        begin, end = _place(x, length)
                        out.append((1, doc_id, mark, x["tau"], x["f"], x["place"], x["m"], x["c"], raw[begin:end], None, None, None, None, None))
                if any(x["c"] and x["m"] == 1 for x in p):
                    out.append((2, doc_id, mark, None, None, None, None, None, raw, [{"begin": a, "end": z} for a, z in spans], None, None, None, None))
                else:
                    out.append((0, doc_id, mark, None, None, None, None, None, None, None, *_removal(raw, spans)))
            columns = list(zip(*out, strict=True)) if out else [()] * 14
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    names = ["kind", "doc_id", "mark", "tau", "f", "place", "m", "c", "body", "spans", *(n for n, _ in _RESULT)]
    types = [pa.int8(), *[pa.int64()] * 7, pa.binary(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), *(t for _, t in _RESULT)]
    result = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema = f"kind byte, doc_id long, mark long, tau long, f long, place long, m long, c long, body binary, spans array<struct<begin:long,end:long>>, {result}"
    first = materialize(_with_phrases(docs, found, "left").mapInArrow(first_pass, schema), "prefix-free")
    release(docs.sparkSession)

    spans = _spans(first.where("kind = 1"), hot, length, gram)
    more = spans.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("begin", "end")).alias("more")).alias("s")
    waiting = first.where("kind = 2").select("doc_id", "mark", "body", "spans").alias("w")
    same = F.col("w.mark").eqNullSafe(F.col("s.mark")) & F.col("w.doc_id").eqNullSafe(F.col("s.doc_id"))

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw, spans, more in zip(*(b.column(n).to_pylist() for n in ("body", "spans", "more")), strict=True):
                out.append(_removal(raw, [(x["begin"], x["end"]) for x in [*spans, *(more or [])]]))
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            columns = [b.column("doc_id"), b.column("mark"), *(pa.array(c, t) for c, (_, t) in zip(columns, _RESULT, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", *(n for n, _ in _RESULT)])

    last = waiting.join(more, same, "left").select("w.doc_id", "w.mark", "w.body", "w.spans", "s.more").mapInArrow(second_pass, f"doc_id long, mark long, {result}")
    return first.where("kind = 0").select("doc_id", "mark", *(n for n, _ in _RESULT)).unionByName(last)


#: A passage: so many words, each as so many bytes of its hash; words of a trigger.
PASSAGE_WORDS, WORD_BYTES, TRIGGER_WORDS = 51, 4, 12


def _as_words(raw: bytes) -> bytes:
    """Hashes of fixed size for words: a passage of words is a string of bytes again."""
    words = raw.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).astype("<u4").tobytes()


def _with_passage(docs: DataFrame, hot: int) -> DataFrame:
    """doc_id, mark of rows with a passage of words that stands elsewhere too."""
    length, gram = WORD_BYTES * PASSAGE_WORDS, WORD_BYTES * TRIGGER_WORDS
    found = _found(docs, _as_words, length, gram, "passages")
    found = materialize(found, "passages-found")
    release(docs.sparkSession)

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, mark, raw, p in zip(*(b.column(n).to_pylist() for n in ("doc_id", "mark", "text", "p")), strict=True):
                raw = _as_words(raw or b"")
                for x in p:
                    begin, end = _place(x, length)
                    out.append((x["tau"], x["f"], doc_id, mark, x["place"], x["m"], raw[begin:end], x["c"]))
            columns = list(zip(*out, strict=True)) if out else [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 6 + [pa.binary(), pa.int64()], strict=True)], names=names)

    names = ["tau", "f", "doc_id", "mark", "place", "m", "body", "c"]
    open_ = found.where("p.c > 0")
    got = _with_phrases(docs, open_, "inner").mapInArrow(contents, "tau long, f long, doc_id long, mark long, place long, m long, body binary, c long")
    got = materialize(got, "passages-contents")
    release(docs.sparkSession)
    rows = found.where("p.m > 1").select("doc_id", "mark").union(_spans(got, hot, length, gram).select("doc_id", "mark"))
    known = materialize(rows.distinct(), "passages-known")
    discard(found, got)
    release(docs.sparkSession)
    return known


def removal_report(docs: DataFrame, hot: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and repeats of every row of docs (doc_id, text; others are ignored).

    repeats: a passage of PASSAGE_WORDS words or more stands elsewhere too, word for word, of whatever bytes; it's found by the same
    parse over hashes of words, and nothing is removed for it. Null texts are empty; texts of under LENGTH bytes keep all.
    Rows that are equal in doc_id and text are copies of each other like any others. hot: phrases that one trigger may
    have in one task; triggers with more are split.
    """
    tuned(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.col("text").cast("binary").alias("text"))
    known = _with_passage(docs, hot).alias("k")
    report = _report(docs, hot, LENGTH, GRAM).alias("r")
    same = F.col("r.mark").eqNullSafe(F.col("k.mark")) & F.col("r.doc_id").eqNullSafe(F.col("k.doc_id"))
    return report.join(known, same, "left").select("r.doc_id", *(f"r.{n}" for n, _ in _RESULT), F.col("k.mark").isNotNull().alias("repeats"))
