"""Token ids as binary shards: independent zstandard frames, a trailing seek table, per-frame checksums.

Shard layout, all integers little-endian:

* one zstandard frame per document, with zstandard's own content checksum; its payload is the document's
  ids as unsigned 16-bit integers if the vocabulary fits, else 32-bit;
* a skippable frame (magic 0x184D2A5D) with the index: width, count, a validity byte and a signed 64-bit
  doc_id for each frame;
* the seek table of the zstandard seekable format, a skippable frame (magic 0x184D2A5E): for each frame its
  compressed size, its decompressed size and the crc32 of its payload; then the number of frames, the
  descriptor 0x80 (checksums present) and the magic 0x8F92EAB1.

A reader takes the footer, then the table, then only the frames of the documents it wants.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterflow.llm.common import filesystem, new_path, tuned

INDEX_MAGIC, TABLE_MAGIC, FOOTER_MAGIC = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
END_ID = 2
#: The usual stand-ins of byte-level vocabularies: printable characters for themselves, the others from U+0100 on.
BYTE_LEVEL = dict(zip((b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)), range(256, 512), strict=False))


class Encoder:
    """Whole texts through the tokenizers library, with the ids of each distinct stretch between spaces kept.

    The vocabulary merges within pre-tokens only and no pre-token holds white space, so a text's ids are those
    of its stretches in order. Texts that aren't in normal form, that have characters outside the ranges on
    which white space and lower case are known to agree with the library's, or that hold an added token's
    string, go through the library as a whole.
    """

    #: Stretches in each of the two generations of kept ids: bounds a worker's memory.
    KEPT = 250_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"not a known normalizer: {kinds}")
        splits = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        if len(splits) != 1:
            raise ValueError("not a known pre-tokenizer")
        # the same classes in the ranges of `odd`, where letters are word characters besides digits and _
        classes = {r"[\p{L}]": r"[^\W\d_]", r"[\p{N}]": r"\d", r"[^\s\p{L}\p{N}]": r"(?:[^\w\s]|_)"}
        self.split = re.compile(re.sub(r"\[\^?(?:\\s)?(?:\\p\{[LN]\})+\]", lambda m: classes[m[0]], splits[0]))
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.odd = re.compile("[^\t\n\r\x20-\x7e\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-ɏͰ-ͳΑ-Ρα-ωА-я‐-‧€]")
        self.width = 2 if self.tok.get_vocab_size() <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.end = array(self.code, [END_ID]).tobytes()
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _stretch(self, s: str) -> bytes:
        out = self.old.get(s)
        if out is None:
            parts = self.split.findall(s)
            if not s.isascii():  # at byte level, printable ASCII characters are themselves
                parts = [p.encode().decode("latin-1").translate(BYTE_LEVEL) for p in parts]
            tokenize = self.tok.model.tokenize
            out = array(self.code, [t.id for p in parts for t in tokenize(p)]).tobytes()
        self.new[s] = out
        return out

    def __call__(self, text: str) -> bytes:
        """The ids of a text, end id included, as they stand in a frame."""
        if self.odd.search(text) or any(s in text for s in self.added) or not unicodedata.is_normalized("NFC", text):
            return array(self.code, self.tok.encode(text, add_special_tokens=False).ids).tobytes() + self.end
        get, stretch = self.new.get, self._stretch
        out = b"".join([get(s) or stretch(s) for s in text.lower().split()]) + self.end
        if len(self.new) >= self.KEPT:
            self.new, self.old = {}, self.new
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process: its kept ids serve all tasks of the worker."""
    return Encoder(path)


def write_shard(out, docs: Iterable[tuple[int | None, bytes]], width: int) -> tuple[int, int]:
    """Write one shard to a binary stream; returns the numbers of documents and ids."""
    pack = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)
    table, valid, ids, total = [], bytearray(), [], 0
    for doc_id, payload in docs:
        out.write(frame := pack.compress(payload))
        table.append(struct.pack("<III", len(frame), len(payload), zlib.crc32(payload)))
        valid.append(doc_id is not None)
        ids.append(doc_id or 0)
        total += len(payload) // width
    index = struct.pack("<II", width, len(ids)) + bytes(valid) + np.array(ids, "<i8").tobytes()
    out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
    body = b"".join(table) + struct.pack("<IBI", len(table), 0x80, FOOTER_MAGIC)
    out.write(struct.pack("<II", TABLE_MAGIC, len(body)) + body)
    return len(ids), total


class ShardReader:
    """Random access to a shard: footer, seek table and index first, then only the frames asked for."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - 9)
        count, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != FOOTER_MAGIC or not flags & 0x80:
            raise ValueError("not a shard: bad footer")
        at = size - 9 - 12 * count - 8
        source.seek(at)
        kind, length = struct.unpack("<II", source.read(8))
        if kind != TABLE_MAGIC or length != 12 * count + 9:
            raise ValueError("not a shard: bad seek table")
        self.table = np.frombuffer(source.read(12 * count), "<u4").reshape(count, 3)
        self.offsets = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        source.seek(int(self.offsets[-1]))
        kind, length = struct.unpack("<II", source.read(8))
        if kind != INDEX_MAGIC:
            raise ValueError("not a shard: bad index")
        body = source.read(length)
        self.width, n = struct.unpack("<II", body[:8])
        valid = np.frombuffer(body[8 : 8 + n], np.uint8)
        ids = np.frombuffer(body[8 + n :], "<i8")
        self.doc_ids = [int(i) if v else None for i, v in zip(ids, valid, strict=True)]
        self.unpack = zstandard.ZstdDecompressor()

    def ids(self, k: int) -> np.ndarray:
        """The ids of the k-th document; ValueError if its checksum doesn't hold."""
        size, raw, crc = (int(x) for x in self.table[k])
        self.source.seek(int(self.offsets[k]))
        payload = self.unpack.decompress(self.source.read(size), max_output_size=raw)
        if len(payload) != raw or zlib.crc32(payload) != crc:
            raise ValueError(f"frame {k}: checksum mismatch")
        return np.frombuffer(payload, "<u2" if self.width == 2 else "<u4").astype("<u4")


def write_tokens(docs: DataFrame, out_dir: str, tokenizer: str) -> list[dict]:
    """Encode and write docs (doc_id long, text string) as shards under out_dir, in ascending doc_id order.

    Null texts are empty and still get the end id; null doc_ids come first and are null again when read;
    repeated doc_ids all stay, ordered by text. An empty table gives no shards. Other columns are ignored. Each
    task writes a file of its own and then moves it to the name of its partition, so a repeated task
    replaces it with the same bytes. Returns the manifest: one entry per shard, with the start (ids before it).
    """
    tuned(docs.sparkSession)
    filesystem(out_dir)[0].create_dir(filesystem(out_dir)[1], recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        encode = encoder(tokenizer)
        fs, root = filesystem(out_dir)
        rows = (
            (i, encode(t or ""))
            for b in batches
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
        )
        first = next(rows, None)
        if first is None:
            return

        def every():
            yield first
            yield from rows

        own = f"{root}/.part-{task.partitionId():06d}-{task.taskAttemptId()}"
        name = f"part-{task.partitionId():06d}.zst"
        with fs.open_output_stream(own) as out:
            n, total = write_shard(out, every(), encode.width)
        fs.move(own, f"{root}/{name}")
        yield pa.RecordBatch.from_pydict({"shard": [task.partitionId()], "name": [name], "n_docs": [n], "n_ids": [total]})

    rows = (
        docs.select("doc_id", "text")
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(write, "shard long, name string, n_docs long, n_ids long")
        .collect()
    )
    manifest, start = [], 0
    for r in sorted(rows, key=lambda r: r["shard"]):
        manifest.append({"name": r["name"], "n_docs": r["n_docs"], "n_ids": r["n_ids"], "start": start})
        start += r["n_ids"]
    fs, root = filesystem(out_dir)
    with fs.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def read_tokens(spark: SparkSession, out_dir: str, manifest: list[dict] | None = None, keep_ids: bool = False) -> DataFrame:
    """Read shards back: doc_id, start, n_tokens, ids_crc32 and, if keep_ids, the ids; checksums are verified."""
    if manifest is None:
        fs, root = filesystem(out_dir)
        with fs.open_input_stream(f"{root}/manifest.json") as f:
            manifest = json.loads(f.read())
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if keep_ids else "")
    arrow = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    arrow = pa.schema(arrow + [("ids", pa.list_(pa.int64()))] * keep_ids)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(out_dir)
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{name}") as f:
                    shard, rows = ShardReader(f, f.size()), []
                    for k, doc_id in enumerate(shard.doc_ids):
                        ids = shard.ids(k)
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), *([ids.tolist()] * keep_ids)))
                        start += len(ids)
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    at = spark.createDataFrame([(m["name"], m["start"]) for m in manifest], "name string, start long")
    return at.repartition(max(1, len(manifest)), F.col("name")).mapInArrow(load, schema)


def token_output(docs: DataFrame, tokenizer: str, out_dir: str | None = None) -> DataFrame:
    """Write docs as shards (to the shared folder unless out_dir is given) and return what a reader sees."""
    spark = docs.sparkSession
    out_dir = out_dir or new_path(spark, "tokens")
    return read_tokens(spark, out_dir, write_tokens(docs, out_dir, tokenizer))
