"""Quality classifier: Bradley-Terry scores learnt from pairs of a better and a worse document."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterflow.llm.common import discard, materialize, release, tuned

#: Documents of the rarer kind, about, that each of the other kind is paired with, and documents of the other kind in a block.
PARTNERS, BLOCK = 32, 1024
#: Pairs whose margins a worker holds at once.
PAIRS = 1 << 20
#: Scores that the driver lists at once, and bins that more are counted in.
LISTED, BINS = 50_000, 4096
FOLDS = 5
KEEP_AT = 0.3
FEATURES = (
    "log_words", "log_bytes", "bytes_per_word", "distinct_words", "top_word", "repeated_lines", "log_lines", "upper",
    "digits", "spaces", "line_feeds", "stops", "commas", "hash_dollar_percent", "bars", "shouts", "angles", "other_ascii",
    "high_bytes", "capital_words", "short_words", "long_words", "repeated_pairs", "deflated",
)


def features(text: str | None) -> list[float]:
    """Numbers between about -3 and 12 from one whole text; empty texts give zeros."""
    raw = (text or "").encode()
    words = raw.split()
    n, size = len(words), len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = lambda chars: float(sum(counts[c] for c in chars)) / size
    seen = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters, upper = range(97, 123), range(65, 91)
    odd = [c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,#$%*&|!<>"]
    pairs = len({*zip(words, words[1:], strict=False)}) / max(1, n - 1)
    lengths = np.fromiter(map(len, words), np.int64, n)
    return [
        math.log1p(n), math.log1p(size), min(30.0, (size - counts[32]) / n) / 3, len(seen) / n, seen.most_common(1)[0][1] / n,
        1 - len(set(lines)) / len(lines), math.log1p(len(lines)), float(sum(counts[c] for c in upper)) / max(1, sum(counts[c] for c in letters) + sum(counts[c] for c in upper)),
        share(range(48, 58)), share(b" "), share(b"\n") * 10, share(b".") * 10, share(b",") * 10, share(b"#$%*&") * 5, share(b"|") * 10, share(b"!") * 10, share(b"<>") * 10,
        share(odd) * 5, float(counts[128:].sum()) / size, sum(w[:1].isupper() for w in words) / n, float((lengths <= 3).mean()), float((lengths >= 16).mean()),
        1 - pairs, len(zlib.compress(raw, 1)) / size,
    ]


@dataclass(frozen=True)
class Ranking:
    """score = sigmoid((weights · (features - mean) / scale - threshold) / spread + logit(KEEP_AT))."""

    weights: tuple[float, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    threshold: float
    spread: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip((z - self.threshold) / self.spread + math.log(KEEP_AT / (1 - KEEP_AT)), -40, 40)))


def _steady(x: np.ndarray) -> np.ndarray:
    """Ten digits: what the order of sums in a run doesn't change."""
    return np.array([float(f"{v:.10g}") for v in np.atleast_1d(x)])


def _summed(rows: DataFrame, run: Callable, length: int) -> np.ndarray:
    """The sum of the vectors that run yields for the batches of each task: one vector a task goes to the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length)
        for b in batches:
            if b.num_rows:
                total += run(b)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["v"])

    got = sorted(r["v"] for r in rows.mapInArrow(add, "v array<double>").collect())
    return np.sum(np.array(got, float).reshape(-1, length), axis=0)


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return b.column("x").flatten().to_numpy().reshape(-1, len(FEATURES))


def _blocks(rows: DataFrame, few: int, n_few: int, n_many: int, mean: np.ndarray, scale: np.ndarray) -> DataFrame:
    """good, z: blocks of standardised documents, those of quality 1 first, of which all of different quality are pairs.

    Every document is in some block: those of the rarer kind (quality few) are dealt to cells of about PARTNERS and go to all blocks of a cell.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = max(1, n_few // PARTNERS)
    parts = max(1, -(-n_many // (cells * BLOCK)))
    cell = F.pmod(F.xxhash64("doc_id", "x", F.lit(11)), F.lit(cells)).alias("cell")
    some = rows.where(F.col("quality") == few).select(cell, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), "quality", "doc_id", "x")
    others = rows.where(F.col("quality") != few).select(cell, F.pmod(F.xxhash64("doc_id", "x", F.lit(13)), F.lit(parts).cast("long")).alias("part"), "quality", "doc_id", "x")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, good, at = [], 0, None

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([good], pa.int64()), pa.array([np.concatenate(held).tobytes()], pa.binary())], names=["good", "z"])

        for b in batches:
            z = np.clip((_matrix(b) - mean) / scale, -6, 6)
            kind = b.column("quality").to_numpy()
            keys = np.column_stack([b.column("cell").to_numpy(), b.column("part").to_numpy()])
            edges = np.append(np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1))), len(z)) if len(z) else [0]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if at != (key := tuple(keys[i].tolist())) and held:
                    yield block()
                    held, good = [], 0
                at = key
                held.append(z[i:j])
                good += int((kind[i:j] == 1).sum())
        if held:
            yield block()

    dealt = some.unionByName(others).repartition(partitions, "cell", "part").sortWithinPartitions("cell", "part", F.desc("quality"), "doc_id", "x")
    out = materialize(dealt.mapInArrow(gather, "good long, z binary"), "ranking-blocks")
    release(rows.sparkSession)
    return out


def _loss(blocks: DataFrame, w: np.ndarray, decay: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean of log(1 + exp(-w·(better - worse))) over all pairs of the blocks with its decay, its gradient and its Hessian."""
    d = len(w)

    def run(b: pa.RecordBatch) -> np.ndarray:
        pairs, loss, grad, hess = 0, 0.0, np.zeros(d), np.zeros((d, d))
        for good, raw in zip(b.column("good").to_pylist(), b.column("z").to_pylist(), strict=True):
            z = np.frombuffer(raw).reshape(-1, d)
            x, y = z[:good], z[good:]
            if not len(x) or not len(y):
                continue
            step = max(1, PAIRS // len(y))
            for k in range(0, len(x), step):
                part = x[k : k + step]
                margin = (part @ w)[:, None] - (y @ w)[None, :]
                p = 1 / (1 + np.exp(np.clip(margin, -700, 700)))
                q = p * (1 - p)
                pairs += margin.size
                loss += float(np.logaddexp(0, -margin).sum())
                grad -= p.sum(1) @ part - p.sum(0) @ y
                both = part.T @ (q @ y)
                hess += (part.T * q.sum(1)) @ part + (y.T * q.sum(0)) @ y - both - both.T
        return np.concatenate([[pairs, loss], grad, hess.ravel()])

    v = _summed(blocks, run, 2 + d + d * d)
    n = max(1.0, v[0])
    return v[1] / n + decay / 2 * float(w @ w), v[2 : 2 + d] / n + decay * w, v[2 + d :].reshape(d, d) / n + decay * np.eye(d)


def _least_loss(blocks: DataFrame, decay: float, steps: int = 40) -> np.ndarray:
    """Weights by Newton's steps, halved where the loss would rise."""
    w = np.zeros(len(FEATURES))
    loss, grad, hess = _loss(blocks, w, decay)
    move, share = np.linalg.solve(hess, grad), 1.0
    for _ in range(steps):
        if np.abs(share * move).max() < 1e-9:
            break
        new = w - share * move
        found = _loss(blocks, new, decay)
        if found[0] > loss + 1e-12:
            share /= 2
            continue
        w, (loss, grad, hess) = new, found
        move, share = np.linalg.solve(hess, grad), 1.0
    return _steady(w)


def at_ranks(values: DataFrame, n: int, ranks: list[int], listed: int = LISTED) -> dict[int, float]:
    """The values of these ranks (from 0) among the n of column s: bins are counted, those with a rank again, and few values are listed."""
    if n <= listed:
        got = sorted(r["s"] for r in values.select("s").collect())
        return {k: got[k] for k in ranks}
    low, high = values.agg(F.min("s"), F.max("s")).first()
    if low == high:
        return dict.fromkeys(ranks, low)
    at = F.least(F.floor((F.col("s") - low) * (BINS / (high - low))), F.lit(BINS - 1))
    out, before = {}, 0
    for r in values.groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.min("s").alias("low"), F.max("s").alias("high")).orderBy("at").collect():
        inside = [k - before for k in ranks if before <= k < before + r["n"]]
        if inside:
            found = at_ranks(values.where(F.col("s").between(r["low"], r["high"])), r["n"], inside, listed)
            out |= {k + before: v for k, v in found.items()}
        before += r["n"]
    return out


def quantile(values: DataFrame, n: int, share: float) -> float:
    """The quantile of the n values of column s, between neighbours in proportion."""
    at = (n - 1) * share
    k = min(int(at), n - 1)
    got = at_ranks(values, n, sorted({k, min(k + 1, n - 1)}))
    return got[k] + (got[min(k + 1, n - 1)] - got[k]) * (at - k)


def fit(rows: DataFrame, decay: float = 1e-3) -> Ranking:
    """The least mean of log(1 + exp(-w·(better - worse))) over pairs of all rows (doc_id, quality, x), each of which is in some.

    The threshold is the quantile of the fitted scores of all rows at the share of worse documents. With labels of one
    kind only there is no pair: all weights are 0 and every score is above the threshold's or below it.
    """
    d = len(FEATURES)

    def moments(b: pa.RecordBatch) -> np.ndarray:
        x, good = _matrix(b), int((b.column("quality").to_numpy() == 1).sum())
        return np.concatenate([[len(x), good, int((b.column("quality").to_numpy() == 0).sum())], x.sum(0), (x * x).sum(0)])

    v = _summed(rows, moments, 3 + 2 * d)
    n, good, bad = (int(c) for c in v[:3])
    if not n:
        mean, scale = np.zeros(d), np.ones(d)
    else:
        mean = _steady(v[3 : 3 + d] / n)
        scale = np.maximum(_steady(np.sqrt(np.maximum(0, v[3 + d :] / n - (v[3 : 3 + d] / n) ** 2))), 1e-6)
    if not good or not bad:
        return Ranking((0.0,) * d, tuple(mean), tuple(scale), -1.0 if good else 1.0, 1.0)
    few = 1 if good <= bad else 0
    blocks = _blocks(rows.where("quality in (0, 1)"), few, min(good, bad), max(good, bad), mean, scale)
    w = _least_loss(blocks, decay)
    discard(blocks)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.clip((_matrix(b) - mean) / scale, -6, 6) @ w
            yield pa.RecordBatch.from_arrays([b.column("quality"), pa.array(s, pa.float64())], names=["quality", "s"])

    scores = materialize(rows.mapInArrow(fitted, "quality int, s double"), "ranking-scores")
    threshold = quantile(scores, n, bad / n)
    # a document kept by mistake costs less than one lost: stand below the better side's lowest hundredth
    threshold = min(threshold, quantile(scores.where("quality = 1"), good, 0.01))
    spread = float(_steady(scores.agg(F.stddev_pop("s")).first()[0])[0])
    discard(scores)
    return Ranking(tuple(w), tuple(mean), tuple(scale), threshold, spread or 1.0)


def fold(doc_id: int | None) -> int:
    return zlib.crc32(str(doc_id).encode()) % FOLDS if doc_id is not None else 0


def fold_column() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS


def _vectors(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.mapInArrow(run, "doc_id long, x array<double>")


def learn(docs: DataFrame, labels: DataFrame) -> Ranking:
    """Fit on all labelled documents of the training folds.

    Labels with a null doc_id or quality don't count; a doc_id with labels of both kinds counts for neither.
    """
    vectors = vectors_of(docs)
    model = learn_vectors(vectors, labels)
    discard(vectors)
    return model


def vectors_of(docs: DataFrame) -> DataFrame:
    """doc_id, x (its features) of every row of docs, written: learning and scoring both read them, and texts are read once."""
    tuned(docs.sparkSession)
    return materialize(_vectors(docs.select("doc_id", "text")), "ranking-vectors")


def learn_vectors(vectors: DataFrame, labels: DataFrame) -> Ranking:
    """learn from the features of documents: of the labelled ones, small rows meet their labels instead of texts."""
    tuned(vectors.sparkSession)
    known = (
        labels.where("doc_id is not null and quality is not null").where(fold_column() != 0)
        .groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
        .where("low = high").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("low").cast("int").alias("quality"))
    )
    rows = materialize(vectors.join(known, "doc_id").select("doc_id", "quality", "x"), "ranking-rows")
    release(vectors.sparkSession)
    model = fit(rows)
    discard(rows)
    return model


def score_vectors(vectors: DataFrame, model: Ranking) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of vectors (doc_id, x); a null doc_id is not held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.scores(_matrix(b)), pa.float64())], names=["doc_id", "score"])

    got = vectors.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")
    return got.select("doc_id", F.coalesce(fold_column() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= KEEP_AT).cast("int").alias("predicted"))


def score(docs: DataFrame, model: Ranking) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs; a narrow map over whole texts.

    Null and empty texts score as the zero vector does; a null doc_id is not held out.
    """
    tuned(docs.sparkSession)
    return score_vectors(_vectors(docs.select("doc_id", "text")), model)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """score of docs by what learn gives for them and labels, their features taken once."""
    vectors = vectors_of(docs)
    return score_vectors(vectors, learn_vectors(vectors, labels))
