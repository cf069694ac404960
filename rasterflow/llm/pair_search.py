"""What the similarity joins share: signatures dealt into buckets, candidates by pivots, verification, components.

A node is a distinct content (its 64-bit name); documents with equal contents are one node, whatever their number.
Members of a bucket meet at pivots first. Then only pairs are verified that lie in different components or, where ranges
are asked for, of which one has no verified range at the place of the signature.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterflow.llm.common import components, discard, materialize, release, tuned

#: Signatures that a worker combines at once: bounds its memory.
FLUSH_ROWS = 500_000
#: Pairs of one pivot that one task verifies; a pivot with more is sent to several.
PIVOT_PAIRS = 256
#: Bytes that one wave of verification deals out, in terms of all contents.
WAVE_SHARE = 3


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: Buckets of signatures for each partition that they are dealt to: a partition's are gathered one after the other.
BUCKETS = 8


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit integers as planes of bytes: planes of few different values compress well."""
    return b"".join(c.view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns)


def _unpacked(blob: bytes, columns: int) -> list[np.ndarray]:
    planes = np.frombuffer(blob, np.uint8).reshape(8 * columns, -1)
    return [np.ascontiguousarray(planes[8 * i : 8 * i + 8].T).view(np.int64).ravel() for i in range(columns)]


def bucket_rows(docs: DataFrame, content: Callable, name: Callable, signatures: Callable, label: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members (sig, node, code) of buckets with several nodes, documents (doc_id, node, size), and the table that holds both.

    content(text) is an array, name(content) its node or None, signatures(contents) the signed 64-bit signatures of several
    contents: to which each belongs, the signature and a code. Signatures go by ranges to buckets, packed: a row for each
    flush of a task and bucket. Of the members within one flush only one is dealt out by signature, with their number, so a
    bucket of any size gets few rows from each task; the others are known to stay and go anywhere.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = partitions * BUCKETS
    made = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("doc_id", pa.int64()), ("node", pa.int64()), ("size", pa.int64()), ("blob", pa.binary())])
    found = pa.schema([("size", pa.int64()), ("sig", pa.int64()), ("node", pa.int64()), ("code", pa.int64())])

    def blobs(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        at, kind, body = zip(*rows, strict=True)
        empty = pa.nulls(len(rows), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(kind, pa.int8()), empty, empty, empty, pa.array(body, pa.binary())], schema=made)

    def combined(sig: list, node: list, code: list) -> Iterator[pa.RecordBatch]:
        s, v, c = np.concatenate(sig).view(np.uint64), np.concatenate(node), np.concatenate(code)
        order = np.argsort(s, kind="stable")
        s, v, c = s[order], v[order], c[order]
        first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        count = np.diff(np.append(first, len(s)))
        at = ((s[first] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        out = []
        edges = np.append(np.flatnonzero(np.append(True, at[1:] != at[:-1])), len(at))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            k = first[a:b]
            out.append((int(at[a]), 1, _packed(s[k], v[k], c[k], count[a:b])))
            if len(out) == 256:
                yield blobs(out)
                out = []
        others = np.ones(len(s), bool)
        others[first] = False
        others = np.flatnonzero(others)
        for a in range(0, len(others), 4096):
            k = others[a : a + 4096]
            out.append((int(scramble(s[k[:1]] ^ v[k[:1]].view(np.uint64))[0] % np.uint64(buckets)), 2, _packed(s[k], v[k], c[k])))
        if out:
            yield blobs(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, done = ([], [], []), 0, set()
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            contents = [content(text) for text in b.column("text").to_pylist()]
            names, sizes = [name(c) for c in contents], [len(c) for c in contents]
            spread = [((n or 0) ^ (i or 0) * 0x9E3779B1 & 0x7FFFFFFF) % buckets for n, i in zip(names, ids, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(spread, pa.int32()), pa.array([0] * len(ids), pa.int8()), pa.array(ids, pa.int64()), pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.nulls(len(ids), pa.binary())], schema=made)
            new = []
            for k, n in enumerate(names):
                if n is not None and n not in done:
                    done.add(n)
                    new.append(k)
            if not new:
                continue
            which, sig, code = signatures([contents[k] for k in new])
            for to, x in zip(held, (sig, np.array([names[k] for k in new], np.int64)[which], code), strict=True):
                to.append(x)
            rows += len(sig)
            if rows >= FLUSH_ROWS:
                yield from combined(*held)
                held, rows, done = ([], [], []), 0, set()
        if rows:
            yield from combined(*held)

    def members(sig: np.ndarray, node: np.ndarray, code: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(len(sig), pa.int64()), pa.array(sig), pa.array(node), pa.array(code)], schema=found)

    def shared(held: list[bytes]) -> pa.RecordBatch:
        """The members of one bucket whose signature several nodes have."""
        s, v, c, n = (np.concatenate(x) for x in zip(*(_unpacked(b, 4) for b in held), strict=True))
        order = np.lexsort((v, s))
        s, v, c, n = s[order], v[order], c[order], n[order]
        begin = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        size = np.diff(np.append(begin, len(s)))
        several = (v[begin] != v[begin + size - 1]) | (np.maximum.reduceat(n, begin) > 1)
        keep = np.repeat(several, size)
        keep[1:] &= (s[1:] != s[:-1]) | (v[1:] != v[:-1])
        return members(s[keep], v[keep], c[keep])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket = [], None
        for b in batches:
            known = pc.equal(b.column("kind"), 0)
            d = b.filter(known)
            if d.num_rows:
                yield pa.RecordBatch.from_arrays([d.column("size"), d.column("doc_id"), d.column("node"), pa.nulls(d.num_rows, pa.int64())], schema=found)
            rest = b.filter(pc.invert(known))
            for at, kind, blob in zip(rest.column("bucket").to_pylist(), rest.column("kind").to_pylist(), rest.column("blob").to_pylist(), strict=True):
                if kind == 2:
                    yield members(*_unpacked(blob, 3))
                    continue
                if at != bucket and held:
                    yield shared(held)
                    held = []
                held.append(blob)
                bucket = at
        if held:
            yield shared(held)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = texts.mapInArrow(run, "bucket int, kind byte, doc_id long, node long, size long, blob binary").repartition(partitions, "bucket")
    rows = materialize(dealt.sortWithinPartitions("bucket").mapInArrow(gather, "size long, sig long, node long, code long"), f"{label}-rows")
    release(spark)
    return rows.where("size is null").select("sig", "node", "code"), rows.where("size is not null").select(F.col("sig").alias("doc_id"), "node", "size"), rows


def without_frequent(members: DataFrame, label: str) -> DataFrame:
    """Members (sig, node) without the buckets that nodes can spare: of each node and group, its `spare` most frequent ones.

    code: group * 2^20 + spare, or -1 for buckets that always stay. Frequencies order all buckets alike for every node, so
    of any `spare` + 1 buckets that two nodes share, the least frequent stays with both.
    """
    counts = materialize(members.groupBy("sig").agg(F.count("*").alias("n")), f"{label}-frequent")
    order = Window.partitionBy("node", F.shiftright("code", 20)).orderBy(F.desc("n"), "sig")
    ranked = members.join(counts, "sig").select("*", F.row_number().over(order).alias("rank"), F.expr(f"if(code < 0, 0, code & {(1 << 20) - 1})").alias("spare"))
    kept = ranked.where("rank > spare").select("sig", "node")
    out = materialize(kept, f"{label}-kept")
    discard(counts)
    release(members.sparkSession)
    return out


def fetch(docs: DataFrame, documents: DataFrame, nodes: DataFrame, content: Callable, name: Callable, label: str, pack: Callable = str.encode) -> DataFrame:
    """node, items (what pack makes of a text that has its content) for nodes: the text of the smallest doc_id that has it."""
    owners = documents.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, items = [], []
            for text, node in zip(b.column("text").to_pylist(), b.column("node").to_pylist(), strict=True):
                item = None if text is None else pack(text)
                if item is not None and name(content(item)) == node:  # of rows with one doc_id, those with this text
                    kept.append(node)
                    items.append(item)
            yield pa.RecordBatch.from_pydict({"node": pa.array(kept, pa.int64()), "items": pa.array(items, pa.binary())})

    wanted = owners.join(nodes, "node", "left_semi")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = texts.join(wanted, "doc_id").select("node", "text").mapInArrow(run, "node long, items binary")
    if documents.groupBy("doc_id").count().where("count > 1").limit(1).count():
        found = found.groupBy("node").agg(F.any_value("items").alias("items"))
    # contents that only rows without a doc_id have
    bare = documents.groupBy("node").agg(F.min("doc_id").alias("doc_id")).where("node is not null and doc_id is null").select("node")
    if bare.limit(1).count():
        texts = texts.where("doc_id is null").select(F.lit(None).cast("long").alias("node"), "text")

        def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = [(n, x) for t in b.column("text").to_pylist() if t is not None and (n := name(content(x := pack(t)))) is not None]
                yield pa.RecordBatch.from_pydict({"node": pa.array([n for n, _ in got], pa.int64()), "items": pa.array([c for _, c in got], pa.binary())})

        alone = texts.mapInArrow(named, "node long, items binary").groupBy("node").agg(F.any_value("items").alias("items"))
        found = found.unionByName(alone.join(bare, "node", "left_semi").join(nodes, "node", "left_semi"))
    found = materialize(found, f"{label}-items")
    release(docs.sparkSession)
    return found


_SPAN = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def verified(pairs: DataFrame, items: DataFrame, content: Callable, check: Callable, label: str) -> DataFrame:
    """pairs (a, b) with linked, xs and ys, as check(content of a, content of b) returns them.

    b is a pair's pivot: its content goes once to each task that verifies pairs with it, however many those are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pivot = None
        for batch in batches:
            out = []
            columns = (batch.column(n).to_pylist() for n in ("b", "role", "node", "items"))
            for b, role, node, raw in zip(*columns, strict=True):
                if role == 0:
                    held, pivot = b, content(raw)
                elif held == b:
                    out.append((node, b, *check(content(raw), pivot)))
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            types = (pa.int64(), pa.int64(), pa.bool_(), _SPAN, _SPAN)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["a", "b", "linked", "xs", "ys"])

    per = materialize(pairs.groupBy("b").agg(F.ceil(F.count("*") / PIVOT_PAIRS).alias("parts")), f"{label}-pivots")
    members = pairs.join(per, "b").select("b", F.col("a").alias("node"), F.pmod(F.xxhash64("a"), "parts").alias("part"), F.lit(1).alias("role"))
    pivots = per.select("b", F.col("b").alias("node"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"))
    out = _in_waves(members.unionByName(pivots), items, run, label)
    discard(per)
    return out


def _in_waves(rows: DataFrame, items: DataFrame, run: Callable, label: str) -> DataFrame:
    """run over rows (b, part, role, node, ...) with the nodes' items, together by b and part and ordered by role and node.

    Contents go once with every row of role 1: in as many waves as keep what is on disk at once to a few times the contents.
    """
    lengths = items.select("node", F.length("items").alias("bytes"))
    sent = rows.where("role = 1").groupBy("node").agg(F.count("*").alias("n")).join(lengths, "node").agg(F.sum(F.col("n") * F.col("bytes"))).first()[0] or 0
    held = lengths.agg(F.sum("bytes")).first()[0] or 1
    waves = max(1, int(-(-sent // (WAVE_SHARE * held))))
    rows = rows.withColumn("wave", F.pmod(F.xxhash64("b", "part"), F.lit(waves)))
    span = "array<struct<begin:long,end:long>>"
    out = None
    for wave in range(waves):
        dealt = items.join(rows.where(F.col("wave") == wave), "node").repartition("b", "part").sortWithinPartitions("b", "part", "role", "node")
        done = materialize(dealt.drop("part", "wave").mapInArrow(run, f"a long, b long, linked boolean, xs {span}, ys {span}"), f"{label}-verified")
        out = done if out is None else out.unionByName(done)
        release(items.sparkSession)
    return out


#: Members and bytes of a block that contents are sifted through at once: bound a worker's memory.
BLOCK_NODES, BLOCK_BYTES = 256, 1 << 20


def _sifted(dealt: DataFrame, open_: DataFrame, seen: DataFrame, items: DataFrame, content: Callable, check: Callable, sieve: Callable, label: str) -> DataFrame:
    """Linked pairs (a, b, linked, xs, ys) among the members (sig, node, comp) of each bucket that lie in different
    components, or of which one is bare. open_: the places (node, codes) where members are bare; seen: pairs not to be asked again.

    Members that are alike lie in one block. Blocks with members that ask - those outside a bucket's largest component and
    bare ones - meet the blocks of all its members, and those members are asked against what their blocks meet: each such
    pair is asked at least once, and a group of many near copies brings rows for blocks and not for pairs. sieve(contents)
    gives a function of a content (and of places, if only those matter, and of the contents, marked, for which all do): the numbers of those that it may link
    with, and a function of one of them that tells more closely whether it may do so, at one of some places or (None) anywhere. A bare member is asked until verified ranges hold all its places.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, members, ask, comps = None, [], None, None
        for batch in batches:
            out = []
            columns = (batch.column(n).to_pylist() for n in ("b", "role", "node", "comp", "codes", "known", "split", "items"))
            for b, role, node, comp, codes, known, split, raw in zip(*columns, strict=True):
                if b != block or (role == 0 and ask):
                    block, members, ask = b, [], None
                if role == 0:
                    members.append((node, comp, content(raw)))
                    continue
                if not members:
                    continue
                if not ask:
                    ask, comps = sieve([c for _, _, c in members]), np.array([c for _, c, _ in members])
                x = content(raw)
                known, codes = {node, *(known or ())}, codes or []
                numbers, may = ask(x, codes, comps != comp) if split else ask(x, codes)
                for k in numbers.tolist():
                    other, its, y = members[k]
                    if other in known or not ((split and its != comp and may(k, None)) or (codes and may(k, codes))):
                        continue
                    linked, xs, ys = check(x, y)
                    if linked:
                        out.append((node, other, linked, xs, ys))
                        codes = [c for c in codes if not any(s["begin"] <= c >> 20 and (c >> 20) + (c & (1 << 20) - 1) <= s["end"] for s in xs)]
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            types = (pa.int64(), pa.int64(), pa.bool_(), _SPAN, _SPAN)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["a", "b", "linked", "xs", "ys"])

    dealt = dealt.join(open_.select("node", F.lit(True).alias("bare")), "node", "left").withColumn("bare", F.coalesce("bare", F.lit(False)))
    sizes = dealt.groupBy("sig", "comp").agg(F.count("*").alias("n"), F.bool_or("bare").alias("any"))
    lead = sizes.groupBy("sig").agg(F.max(F.struct("n", "comp"))["comp"].alias("lead"), F.count("*").alias("comps"), F.bool_or("any").alias("any"), F.sum("n").alias("n"))
    dealt = materialize(dealt.join(lead.where("n > 1 and (comps > 1 or any)").select("sig", "lead"), "sig"), f"{label}-split")
    near = dealt.groupBy("node", "comp").agg(F.min(F.xxhash64("sig")).alias("near")).join(items.select("node", F.length("items").alias("bytes")), "node")
    parts = near.groupBy("near").agg(F.greatest(F.ceil(F.count("*") / BLOCK_NODES), F.ceil(F.sum("bytes") / BLOCK_BYTES)).alias("blocks"))
    blocks = materialize(near.join(parts, "near").select("node", "comp", F.xxhash64("near", F.pmod(F.xxhash64("node"), "blocks")).alias("b")), f"{label}-blocks")
    placed = dealt.join(blocks.select("node", "b"), "node")
    held = placed.groupBy("sig", "b").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    outside = placed.where("comp <> lead or bare")
    asking = outside.groupBy("sig", F.col("b").alias("of")).agg(F.min("comp").alias("a0"), F.max("comp").alias("a1"), F.bool_or("bare").alias("any"))
    pairs = asking.join(held, "sig").withColumn("split", F.expr("a0 <> a1 or c0 <> c1 or a0 <> c0")).where("split or any")
    met = materialize(pairs.groupBy("of", "b").agg(F.bool_or("split").alias("split")), f"{label}-met")
    # what has been verified with a node, by the block it lies in
    both = seen.select(F.col("a").alias("node"), F.col("b").alias("other")).union(seen.select(F.col("b").alias("node"), F.col("a").alias("other")))
    known = both.join(blocks.select(F.col("node").alias("other"), "b"), "other").groupBy("node", "b").agg(F.collect_set("other").alias("known"))
    asked = outside.select(F.col("b").alias("of"), "node", "comp", "bare").distinct().join(met, "of").where("split or bare").select("b", "node", "comp", "split")
    asks = materialize(asked.join(open_, "node", "left").join(known, ["node", "b"], "left"), f"{label}-asks")
    discard(met)
    per = materialize(asks.groupBy("b").agg(F.ceil(F.count("*") / BLOCK_NODES).alias("parts")), f"{label}-asked")
    one = asks.join(per, "b").select("b", "node", "comp", "codes", "known", "split", F.pmod(F.xxhash64("node"), "parts").alias("part"), F.lit(1).alias("role"))
    others = blocks.join(per, "b").select("b", "node", "comp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"))
    out = _in_waves(one.unionByName(others, allowMissingColumns=True), items, run, f"{label}-sifted")
    discard(dealt, blocks, asks, per)
    return out


def _once(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) of different nodes, each once, with one of its ends as the pivot b."""
    low, high = F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")
    each = pairs.where("a <> b").groupBy(low, high).agg(F.min("b").alias("b"))
    return each.selectExpr("if(b = low, high, low) as a", "b")


#: Members of a bucket that are small enough to be paired with each other at once.
FEW = 16
#: Partners that a member that is bare in a large bucket meets first; while it is still bare, it is asked against all others (_sifted).
PARTNERS = 3


#: The last bits of a sketch's 512 counts, 64 to a column: two sketches differ by at least as much as these bits do.
COARSE = [f"k{i}" for i in range(8)]


def place(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Where a member's signature stands, as its code: begin * 2^20 + length."""
    return (begin.astype(np.int64) << 20) + (end - begin)


def _spans(seen: DataFrame) -> DataFrame:
    """node, spans: the distinct ranges that are verified with any partner."""
    linked = seen.where("linked")
    each = linked.selectExpr("a as node", "explode(xs) as s").union(linked.selectExpr("b as node", "explode(ys) as s"))
    return each.groupBy("node").agg(F.collect_set("s").alias("spans"))


def _pairs(left: DataFrame, right: DataFrame, limit: str | None = None, ordered: bool = True) -> DataFrame:
    """Pairs (a, b) of the members of each bucket that are in different components, or of which one is bare there.

    limit: SQL over nx and ny, the most in which contents of these sizes may differ; the counts' last bits are compared in the join.
    """
    extra = ["size", *COARSE] if limit else []
    x = left.select("sig", F.col("node").alias("a"), F.col("comp").alias("ca"), F.col("bare").alias("ba"), *[F.col(c).alias(f"x_{c}") for c in extra])
    y = right.select("sig", F.col("node").alias("b"), F.col("comp").alias("cb"), F.col("bare").alias("bb"), *[F.col(c).alias(f"y_{c}") for c in extra])
    same = (x["sig"] == y["sig"]) & (F.col("a") < F.col("b") if ordered else F.col("a") != F.col("b")) & F.expr("ca <> cb or ba or bb")
    if limit:
        apart = " + ".join(f"bit_count(x_{c} ^ y_{c})" for c in COARSE)
        same = same & F.expr(f"{apart} <= {limit}".replace("nx", "x_size").replace("ny", "y_size"))
    return x.join(y, same).select("a", "b")


def _pivots(many: DataFrame, count: int) -> DataFrame:
    """sig, node, comp, bare: for each bucket its `count` members of the smallest hashes, each under a hash of its own."""
    picks = [F.min(F.struct(F.xxhash64("node", F.lit(t)).alias("h"), F.col("node"), F.col("comp"), F.col("bare"))).alias(f"p{t}") for t in range(count)]
    each = many.groupBy("sig").agg(*picks).select("sig", F.explode(F.array(*[F.struct(f"p{t}.node", f"p{t}.comp", f"p{t}.bare") for t in range(count)])).alias("p"))
    return each.select("sig", "p.node", "p.comp", "p.bare").distinct()


def _sketches(items: DataFrame, content: Callable, sketch: Callable, label: str) -> DataFrame:
    """node, size, sketch (512 counts, 255 at most each) and the counts' last bits."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            contents = [content(x) for x in b.column("items").to_pylist()]
            counts = np.array([sketch(c) for c in contents])
            coarse = np.packbits((counts & 1).astype(np.uint8), axis=1).view("<i8")
            fine = [x.tobytes() for x in np.minimum(counts, 255).astype(np.uint8)]
            columns = {"node": b.column("node"), "size": pa.array([len(c) for c in contents], pa.int64()), "sketch": pa.array(fine, pa.binary())}
            yield pa.RecordBatch.from_pydict(columns | {c: pa.array(coarse[:, i], pa.int64()) for i, c in enumerate(COARSE)})

    schema = "node long, size long, sketch binary, " + ", ".join(f"{c} long" for c in COARSE)
    return materialize(items.select("node", "items").mapInArrow(make, schema), f"{label}-sketches")


def _possible(pairs: DataFrame, sketches: DataFrame, most: Callable) -> DataFrame:
    """The pairs whose sketches differ in no more than linked contents can."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(n).to_pylist()), np.uint8).reshape(b.num_rows, -1).astype(np.int16) for n in ("x", "y"))
            limit = most(b.column("nx").to_numpy(), b.column("ny").to_numpy())
            ok = np.abs(x - y).sum(axis=1) <= limit
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok))

    left = sketches.select(F.col("node").alias("a"), F.col("size").alias("nx"), F.col("sketch").alias("x"))
    right = sketches.select(F.col("node").alias("b"), F.col("size").alias("ny"), F.col("sketch").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "nx", "ny", "x", "y").mapInArrow(keep, "a long, b long")


def _rare(open_: DataFrame, items: DataFrame, content: Callable, rare: Callable, label: str) -> DataFrame:
    """Buckets (sig, node) of rare elements for members of large buckets: two that can be linked still share one of those.

    rare(content, codes) gives for each part of a content in which a link can lie its distinct elements and how many of the
    rarest of them hold one of the link's whatever they are: linked parts share an element that is among the rarest of both.
    What a large bucket's members have in common is frequent, so it's rarely among them.
    """
    wanted = open_.groupBy("node").agg(F.collect_set("code").alias("codes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for node, raw, codes in zip(*(b.column(n).to_pylist() for n in ("node", "items", "codes")), strict=True):
                for k, (elements, most) in enumerate(rare(content(raw), codes)):
                    rows.append((node, k, len(elements), most, elements))
            if not rows:
                continue
            node, part, size, most, elements = zip(*rows, strict=True)
            columns = {n: pa.array(np.repeat(np.array(c, np.int64), size)) for n, c in (("node", node), ("part", part), ("total", size), ("most", most))}
            yield pa.RecordBatch.from_pydict(columns | {"element": pa.array(np.concatenate(elements).view(np.int64))})

    parts = items.join(wanted, "node").select("node", "items", "codes").mapInArrow(run, "node long, part long, total long, most long, element long")
    parts = materialize(parts, f"{label}-elements")
    counts = materialize(parts.groupBy("element").agg(F.count("*").alias("n")).where("n > 1"), f"{label}-counts")
    by = Window.partitionBy("node", "part")
    shared = parts.join(counts, "element").withColumn("rank", F.row_number().over(by.orderBy("n", "element"))).withColumn("others", F.col("total") - F.count("*").over(by))
    kept = materialize(shared.where("rank + others <= most").select(F.col("element").alias("sig"), "node").distinct(), f"{label}-rare")
    release(items.sparkSession)
    discard(parts, counts)
    return kept


def _runs(open_: DataFrame, items: DataFrame, content: Callable, runs: Callable, label: str) -> DataFrame:
    """Buckets (sig, node) of the runs of elements, as runs(content, codes) names them, that several members of large buckets have."""
    wanted = open_.groupBy("node").agg(F.collect_set("code").alias("codes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [runs(content(raw), codes) for raw, codes in zip(b.column("items").to_pylist(), b.column("codes").to_pylist(), strict=True)]
            if b.num_rows:
                node = np.repeat(b.column("node").to_numpy(), [len(g) for g in got])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got).view(np.int64)), pa.array(node)], names=["sig", "node"])

    rows = materialize(items.join(wanted, "node").select("node", "items", "codes").mapInArrow(run, "sig long, node long"), f"{label}-every")
    counts = materialize(rows.groupBy("sig").agg(F.count("*").alias("n")).where("n > 1"), f"{label}-counts")
    kept = materialize(rows.join(counts.select("sig"), "sig"), f"{label}-runs")
    discard(rows, counts)
    release(items.sparkSession)
    return kept


def search(docs: DataFrame, documents: DataFrame, members: DataFrame, content: Callable, name: Callable, check: Callable, rare: Callable, label: str, sketch: Callable | None = None, most: Callable | None = None, limit: str | None = None, runs: Callable | None = None, sieve: Callable | None = None, pack: Callable = str.encode) -> tuple[DataFrame, DataFrame]:
    """Verified pairs (a, b, linked, xs, ys) and the components (node, comp) of nodes with links. members: sig, node.

    First each node meets the pivot with which it shares most buckets. Then come the buckets whose members still lie in
    several components: pairs from different components in those of few members, and a pivot (or several) each in larger ones.
    Members of larger buckets are dealt anew by their rare elements (_rare). At last come all pairs of a bucket of few members
    or of a rare element that still lie in different components, so no link between components is lost.
    runs (for ranges; else None): members also have the place (code) of their signature, and are bare in a bucket while no verified range of theirs
    holds it. Until the last round, pairs of which one is bare count like those of different components, so ranges are found
    besides links: all in buckets of few members; in larger ones, first the PARTNERS with which a member shares the longest runs.
    sieve (with runs): the last round of large buckets goes through blocks (_sifted) instead of pairs, and asks members that
    are still bare against all others of theirs, so partners only come first and none is dropped.
    sketch(content): counts that differ in no more than their contents do; pairs whose counts differ by more than
    most(size of one, size of the other), which limit is in SQL, can't be linked and are left out before contents are read.
    pack(text): the bytes by which texts are dealt out; content is called with these.
    """
    tuned(docs.sparkSession)
    places = runs is not None
    pivots = members.groupBy("sig").agg(F.min("node").alias("b"), F.max("node").alias("other")).where("b <> other").select("sig", "b")
    star = members.join(pivots, "sig").where("node <> b").groupBy(F.col("node").alias("a"), "b").agg(F.count("*").alias("n"))
    best = materialize(_once(star.groupBy("a").agg(F.max(F.struct("n", "b")).alias("m")).selectExpr("a", "m.b as b")), f"{label}-best")
    release(docs.sparkSession)
    active = members.join(pivots, "sig", "left_semi").select("node").distinct()
    items = fetch(docs, documents, active, content, name, label, pack)
    seen = verified(best, items, content, check, f"{label}-best")
    part = components(seen.where("linked"), f"{label}-cc")

    sketches = _sketches(items, content, sketch, label) if sketch else None

    def opened(members: DataFrame) -> DataFrame:
        known = part.join(_spans(seen), "node", "left") if places else part
        bare = "not coalesce(exists(spans, s -> s.begin <= shiftright(code, 20) and shiftright(code, 20) + (code & 1048575) <= s.end), false)"
        code = F.col("code") if places else F.lit(0).cast("long").alias("code")
        placed = members.join(known, "node", "left").select("sig", "node", code, F.coalesce("comp", "node").alias("comp"), F.expr(bare if places else "false").alias("bare"))
        counted = placed.groupBy("sig").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("n"), F.bool_or("bare").alias("any"))
        split = counted.where("n > 1 and (c0 <> c1 or any)").select("sig", "n")
        return materialize(placed.join(split, "sig"), f"{label}-open")

    rare_rows = run_rows = table = None
    for turn in range(3 if places else 2):
        last = turn == (2 if places else 1)
        # what is closed stays closed: components only grow, and so do verified ranges
        old, table = table, opened(members if table is None else table.select("sig", "node", "code"))
        discard(old)
        open_ = table
        few, many = open_.where(F.col("n") <= FEW), open_.where(F.col("n") > FEW)
        of = open_.groupBy("node").agg(F.first("comp").alias("comp"), F.bool_or("bare").alias("bare"))
        if sketch:
            few, many, of = (t.join(sketches.drop("sketch"), "node") for t in (few, many, of))
        if last:
            rare_rows = _rare(table.where(F.col("n") > FEW), items, content, rare, label)
        if last:
            few, dealt = (t.withColumn("bare", F.lit(False)) for t in (few, rare_rows.join(of, "node")))
            pairs = _pairs(few, few, limit)
            if not sieve:
                pairs = pairs.union(_pairs(dealt, dealt, limit))
        elif turn:
            run_rows = _runs(table.where(F.col("n") > FEW), items, content, runs, label)
            dealt = run_rows.join(of, "node")
            near = _pairs(dealt, _pivots(dealt, 2), ordered=False).groupBy("a", "b").agg(F.count("*").alias("n"))
            near = near.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n"), "b"))).where(F.col("rank") <= PARTNERS)
            pairs = _pairs(few, few).union(near.select("a", "b"))
        else:
            # sets have no ranges to cover, so members of a large bucket had better be of few components before the last round
            pivots = _pivots(many, 1 if places else 8)
            if sketch:
                pivots = pivots.join(sketches.drop("sketch"), "node")
            first = _pairs(few, _pivots(few, 1), ordered=False) if places else _pairs(few, few, limit)
            pairs = first.union(_pairs(many, pivots, limit, ordered=False))
        known = seen.select("a", "b").union(seen.selectExpr("b as a", "a as b"))
        pairs = materialize(_once(pairs).join(known, ["a", "b"], "left_anti"), f"{label}-pairs")
        discard(run_rows)
        release(docs.sparkSession)
        if sketch:
            pairs, old = materialize(_possible(pairs, sketches, most), f"{label}-possible"), pairs
            discard(old)
            release(docs.sparkSession)
        some = pairs.limit(1).count() > 0
        if some:
            seen = seen.unionByName(verified(pairs, items, content, check, f"{label}-more"))
        if last and sieve:
            # members that the partners have left bare are asked against all others of their buckets
            bare = materialize(table.where(F.col("n") > FEW).where("bare").groupBy("node").agg(F.collect_set("code").alias("codes")), f"{label}-bare")
            seen = seen.unionByName(_sifted(dealt.select("sig", "node", "comp"), bare, seen, items, content, check, sieve, label))
            discard(bare)
            some = True
        if some:
            discard(part, pairs)
            part = components(seen.where("linked"), f"{label}-cc")
    discard(rare_rows, table)
    discard(best, items, sketches)
    return seen, part


def smallest(documents: DataFrame, part: DataFrame) -> DataFrame:
    """node, component_id (smallest doc_id in its component), copies, size of every node."""
    nodes = documents.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.max("size").alias("size"))
    named = nodes.join(part, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    # written, so that the join can split a component of many nodes
    least = materialize(named.groupBy("comp").agg(F.min("doc_id").alias("component_id")), "least")
    return named.join(least, "comp").select("node", "component_id", "copies", "size")
