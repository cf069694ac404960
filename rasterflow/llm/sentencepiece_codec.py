"""SentencePiece encoding and decoding over a stream of characters.

The lattice of a SentencePiece model is walked left to right. For each end position the walk keeps, per piece
that may end there, the backpointer of its best predecessor, for no longer than the longest piece; as soon as
all surviving paths pass one boundary, the ids before it are committed. In a model of type BPE the best path
is the one whose neighbours all stay apart under the model's merges, and it is the only survivor at each
position; in a unigram model it is the path of the highest score. Both give the ids of the library.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rasterflow.llm.common import tuned

SPACE = "▁"


class PieceModel:
    """Pieces, scores and kinds of a SentencePiece model with an identity normaliser."""

    NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.normalizer_spec.name != "identity" or model.normalizer_spec.precompiled_charsmap:
            raise ValueError("only models with the identity normaliser are supported")
        self.prefix = model.normalizer_spec.add_dummy_prefix
        self.squeeze = model.normalizer_spec.remove_extra_whitespaces
        self.bpe = model.trainer_spec.model_type == 2
        self.pieces = [p.piece for p in model.pieces]
        kinds = [p.type for p in model.pieces]
        self.score = {p.piece: p.score for p in model.pieces if p.type in (self.NORMAL, self.USER)}
        self.id = {p: i for i, p in enumerate(self.pieces) if kinds[i] in (self.NORMAL, self.USER)}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if kinds[i] == self.BYTE}
        self.unknown = kinds.index(self.UNKNOWN)
        self.shown = [
            chr(0xD800 + int(p[3:5], 16)) if k == self.BYTE else "" if k == self.CONTROL else " ⁇ " if k == self.UNKNOWN else p.replace(SPACE, " ")
            for p, k in zip(self.pieces, kinds, strict=True)
        ]
        self.longest = max(map(len, self.id))
        #: Neighbouring characters that some piece holds; between all others every path has a boundary.
        self.inside = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}

    def normalize(self, text: str) -> str:
        if self.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        if not text:
            return ""
        return (SPACE if self.prefix else "") + text.replace(" ", SPACE)


class StreamingViterbi:
    """Encodes normalised text that comes in pieces of any size; committed ids come out as soon as they are sure."""

    #: Entries in each generation of kept results: bounds a worker's memory.
    KEPT = 400_000
    KEPT_PAIRS = 250_000

    def __init__(self, model: PieceModel):
        self.m = model
        #: Ids of stretches, as little-endian 32-bit integers.
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.merges: dict[tuple[str, str], bool] = {}
        self.cutter = self._cutter()
        #: Pieces that their own merges make: only those can stand in an encoding of type BPE.
        self.order = {p: i for i, p in enumerate(sorted((p for p in model.id if len(p) > 1), key=lambda p: -model.score[p]))}
        self.children: dict[str, tuple[str, str]] = {}
        for p in self.order if model.bpe else ():
            parts, last = self._merged(p)
            if len(parts) == 1 and last:
                self.children[p] = last
        self.whole = frozenset(model.id if not model.bpe else [*self.children, *(p for p in model.id if len(p) == 1)])
        #: By the last three characters before a position, how long pieces that end there can be: the longest first.
        self.sizes: dict[str, tuple[int, ...]] = {}
        for n in sorted({len(p) for p in self.whole if len(p) > 2}, reverse=True):
            for end in {p[-3:] for p in self.whole if len(p) == n}:
                self.sizes[end] = (*self.sizes.get(end, ()), n)
        self.sizes = {end: (*n, 2, 1) if end[1:] in self.whole else (*n, 1) for end, n in self.sizes.items()}

    def _apart(self, left: str, right: str) -> bool:
        """True if the merges of left + right leave both as they are: two pieces that their own merges make.

        Undoes their merges, the last one first. If at any time the neighbours at the seam could have merged
        before the merge just undone (or as early, and further left), they would have.
        """
        if len(self.merges) >= self.KEPT_PAIRS:
            self.merges.clear()
        order, children = self.order, self.children
        a, b, limit, apart = left, right, len(order), True
        while True:
            joined = order.get(a + b)
            if joined is not None and joined < limit:
                apart = False
                break
            x, y = order.get(a, -1) if len(a) > 1 else -1, order.get(b, -1) if len(b) > 1 else -1
            if x > y:
                limit, a = x, children[a][1]
            elif y >= 0:
                limit, b = y + 1, children[b][0]
            else:
                break
        self.merges[left, right] = apart
        return apart

    def _merged(self, s: str) -> tuple[list[str], tuple[str, str] | None]:
        """The merges of one short string, best score first and leftmost first among equals; and the last of them."""
        order, parts, last = self.order, list(s), None
        while len(parts) > 1:
            best = min(((order[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in order), default=None)
            if best is None:
                break
            i = best[1]
            last = parts[i], parts[i + 1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts, last

    def _ids(self, piece: str) -> tuple[int, ...]:
        if piece in self.m.id:
            return (self.m.id[piece],)
        if self.m.bytes:
            return tuple(self.m.bytes[b] for b in piece.encode())
        return (self.m.unknown,)

    def lattice(self, s: str) -> Iterator[int]:
        """Committed ids of one stretch of text, walked once from left to right.

        back[e]: length of the survivor's last piece at e, 0 where no path passes. Once a window is full, the ids before the
        last boundary that all surviving paths share are committed, and their backpointers go.
        """
        steps, longest = self._merge_steps if self.m.bpe else self._score_step, self.m.longest
        back, total = [0], [0.0]
        done = 0
        while done + len(back) <= len(s):
            # up to a full window, or one position more where nothing could be committed
            end = min(len(s), max(done + 2 * longest, done + len(back)))
            steps(s, done, end, back, total)
            if end == len(s):
                break
            # survivors: the positions from which a later piece can still start
            alive = [e for e in range(max(0, end - done - longest + 1), end - done + 1) if back[e] or not e]
            if common := self._converged(back, alive):
                yield from self._path(s, back, done, common)
                done += common
                del back[:common], total[:common]
        yield from self._path(s, back, done, len(s) - done)

    def _merge_steps(self, s: str, done: int, stop: int, back: list[int], total: list[float]) -> None:
        """Type BPE: the survivor at a position is the path whose pieces all stay apart under the merges; there is one at most."""
        whole, merges, sizes, apart = self.whole, self.merges, self.sizes, self._apart
        pair = (2, 1)
        for end in range(done + len(back), stop + 1):
            best = 0
            for size in sizes.get(s[end - 3 : end], pair) if end > 2 else pair:
                begin = end - size
                if begin < done:
                    continue
                piece = s[begin:end]
                if size > 1 and piece not in whole:
                    continue
                if begin:
                    last = back[begin - done]
                    if not last:
                        continue
                    left = s[begin - last : begin]
                    ok = merges.get((left, piece))
                    if not (apart(left, piece) if ok is None else ok):
                        continue
                best = size
                break
            back.append(best)

    def _score_step(self, s: str, done: int, stop: int, back: list[int], total: list[float]) -> None:
        """A unigram model: the survivor at a position is the path of the highest score."""
        known, score, longest = self.m.id, self.m.score, self.m.longest
        for end in range(done + len(back), stop + 1):
            best, most = 0, 0.0
            for size in range(1, min(longest, end - done) + 1):
                piece = s[end - size : end]
                if size > 1 and piece not in known:
                    continue
                now = total[end - size - done] + score.get(piece, -1e4)
                if not best or now > most:
                    best, most = size, now
            back.append(best)
            total.append(most)

    @staticmethod
    def _converged(back: list[int], alive: list[int]) -> int:
        """The last boundary that all surviving paths share, counted from the window's begin."""
        front = set(alive)
        while len(front) > 1:
            top = max(front)
            front.discard(top)
            front.add(top - back[top])
        return front.pop() if front else 0

    def _path(self, s: str, back: list[int], done: int, end: int) -> list[int]:
        """The ids of the path from the window's begin to `end` of it."""
        out, known = [], self.m.id
        while end:
            size = back[end]
            piece = s[done + end - size : done + end]
            i = known.get(piece)
            if i is None:
                out += self._ids(piece)[::-1]
            else:
                out.append(i)
            end -= size
        return out[::-1]

    def _chunk(self, s: str) -> bytes:
        got = self.memo.get(s) or self.old.get(s)
        if got is None:
            parts = [s] if s[1:].isalpha() else self._parted(s)
            if len(parts) > 1:
                got = b"".join([self.memo.get(p) or self._chunk(p) for p in parts])
            else:
                ids = list(self.lattice(s))
                got = struct.pack(f"<{len(ids)}I", *ids)
        if len(self.memo) >= self.KEPT:
            self.memo, self.old = {}, self.memo
        self.memo[s] = got
        return got

    def _parted(self, s: str) -> list[str]:
        """A stretch cut between characters that no piece holds side by side: every path has a boundary there."""
        inside, out, at = self.m.inside, [], 0
        for i in range(1, len(s)):
            if s[i - 1 : i + 1] not in inside:
                out.append(s[at:i])
                at = i
        out.append(s[at:])
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a whole raw text: stretches between boundaries that no piece crosses, each through the lattice."""
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def packed(self, text: str) -> bytes:
        """encode, as little-endian 32-bit integers."""
        memo, chunk = self.memo, self._chunk
        return b"".join([memo.get(s) or chunk(s) for s in self.cut(self.m.normalize(text))])

    def _cutter(self) -> re.Pattern | None:
        """What finds the stretches: no piece has a space after another character, so a run of spaces begins one."""
        if any(p[1] == SPACE and p[0] != SPACE for p in self.m.inside):
            return None
        if any("\n" in p for p in self.m.inside):
            return re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        return re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}*\n|{SPACE}+")

    def cut(self, s: str) -> list[str]:
        return self.cutter.findall(s) if self.cutter else [s]


@lru_cache(maxsize=2)
def coder(path: str) -> StreamingViterbi:
    """One coder per worker process: its kept stretches serve all tasks of the worker."""
    return StreamingViterbi(PieceModel(path))


#: Stand-ins of byte ids while pieces are joined: lone surrogates, which no text can hold.
_BYTES = re.compile("[\ud800-\ud8ff]+")


def _as_text(m: re.Match) -> str:
    return bytes(ord(c) - 0xD800 for c in m[0]).decode("utf-8", "replace")


def decode(model: PieceModel, ids: Iterable[int]) -> str:
    """The text of ids: pieces with spaces put back, runs of byte ids as UTF-8, the space of the prefix taken off."""
    text = _BYTES.sub(_as_text, "".join(map(model.shown.__getitem__, ids)))
    return text[1:] if model.prefix and text.startswith(" ") else text


def encode_documents(docs: DataFrame, model_path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (little-endian unsigned 32-bit ids), n_chars and round_trip of every row of docs.

    round_trip: decoding the ids gives the text back. (A model that reads ▁ as a space gives a space for it.)
    Null texts are empty and have no ids. A narrow map: no shuffle; a worker holds one batch and a bounded table
    of stretches. Repeated rows each get theirs; other columns are ignored.
    """
    tuned(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        viterbi = coder(model_path)
        model = viterbi.m
        for b in batches:
            n, crc, chars, same, kept = [], [], [], [], []
            for text in b.column("text").to_pylist():
                text = text or ""
                packed = viterbi.packed(text)
                ids = np.frombuffer(packed, "<u4")
                n.append(len(ids))
                crc.append(zlib.crc32(packed))
                back = decode(model, ids.tolist())
                chars.append(len(back))
                same.append(back == text.replace(SPACE, " "))
                kept.append(ids.astype(np.int32) if keep_ids else None)
            got = {"doc_id": b.column("doc_id").cast(pa.int64()), "n_ids": pa.array(n, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()), "n_chars": pa.array(chars, pa.int64()), "round_trip": pa.array(same, pa.bool_())}
            yield pa.RecordBatch.from_pydict(got | ({"ids": pa.array(kept, pa.list_(pa.int32()))} if keep_ids else {}))

    schema = "doc_id long, n_ids long, ids_crc32 long, n_chars long, round_trip boolean" + (", ids array<int>" if keep_ids else "")
    return docs.select("doc_id", "text").mapInArrow(run, schema)
