"""Secret scans: fixed patterns, and a token-efficiency test that finds random strings."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from rasterflow.llm.common import tuned

KINDS = ("assign", "access", "hex", "random")


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = re.compile(
    "(?:" + "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Strings that may be random or hold random parts: long runs of the base64 alphabets.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
LEAST = 16
#: Below this length, strings with separators are often names of short words and numbers: 99.7 % of random ones are within SHORT_RATIO.
LONG, SHORT_RATIO = 20, 1.6
PART = re.compile(r"[A-Za-z0-9]+=*")
#: Parts of up to so many characters that look like a word or number may still belong to a random string around them.
SHORT = 4
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}
#: Names put together of words and numbers: snake_case, kebab-case, paths.
NAME = re.compile(r"(?:[A-Z]?[a-z]*|[A-Z]+|[0-9]{1,8})(?:[-_/+](?:[A-Z]?[a-z]*|[A-Z]+|[0-9]{1,8}))*")
#: Dates with times, as in file names.
STAMP = re.compile(r"(?:[A-Za-z]*[-_/])*[0-9]{4}[-_/]?[0-9]{2}[-_/]?[0-9]{2}[-_/T]?[0-9]{2}[-_]?[0-9]{2}(?:[-_]?[0-9]{2,9})?Z?(?:[-_+/][A-Za-z0-9]{1,5})*")
MAX_CHARS_PER_TOKEN = 2.0


class TokenEfficiency:
    """Characters per token of a string under a tiktoken vocabulary."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, s: str) -> float:
        return len(s) / max(1, len(self.encoding.encode_ordinary(s)))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns; matches that fail their length are dropped, not retried."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _outside(begin: int, end: int, cuts: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What cuts (sorted by their begins) leave of a range."""
    for a, b in cuts:
        if a < end and begin < b:
            if begin < a:
                yield begin, a
            begin = max(begin, b)
    if begin < end:
        yield begin, end


def _stretches(text: str, begin: int, end: int) -> Iterator[tuple[int, int]]:
    """Parts between separators, as far as they stand together, without the words of a path or name around them."""
    held: tuple[int, int] | None = None
    for m in PART.finditer(text, begin, end):
        if not NAME.fullmatch(m.group()):
            held = (held[0] if held else m.start(), m.end())
        elif held and len(m.group()) > SHORT:
            yield held
            held = None
    if held:
        yield held


def random_spans(text: str, base: list[tuple[int, int, int]], ratio: TokenEfficiency, limit: float = MAX_CHARS_PER_TOKEN) -> list[tuple[int, int, int]]:
    """Strings of letters and digits that the vocabulary can't shorten, besides digests, identifiers and base spans.

    What base spans leave of a run is judged as a whole, and if that doesn't pass, by its parts between separators: first
    those that stand together, then each alone.
    """

    def random(a: int, b: int) -> bool:
        s = text[a:b]
        if len(s.rstrip("=")) < LEAST or not (any(c.isdigit() for c in s) and any(c.isalpha() for c in s)):
            return False
        if UUID.fullmatch(s) or (len(s) in DIGEST_LENGTHS and DIGEST.fullmatch(s)) or NAME.fullmatch(s) or STAMP.fullmatch(s):
            return False
        short = len(s) < LONG and not s.rstrip("=").isalnum()
        return ratio(s) <= (min(limit, SHORT_RATIO) if short else limit)

    out = []
    cuts = [(a, b) for a, _, b in base]
    for m in CANDIDATE.finditer(text):
        for a, b in _outside(m.start(), m.end(), cuts):
            # separators beside a cut belong to neither
            while a > m.start() and a < b and text[a] in "+/_-=":
                a += 1
            while b < m.end() and a < b and text[b - 1] in "+/_-":
                b -= 1
            if random(a, b):
                out.append((a, 3, b))
                continue
            known = [u.span() for u in UUID.finditer(text, a, b)]
            for piece in _outside(a, b, known):
                for c, d in _stretches(text, *piece):
                    if random(c, d):
                        out.append((c, 3, d))
                    else:
                        out += [(q.start(), 3, q.end()) for q in PART.finditer(text, c, d) if (q.start(), q.end()) != (c, d) and random(q.start(), q.end())]
    return out


def scan(text: str, ratio: TokenEfficiency, limit: float = MAX_CHARS_PER_TOKEN) -> tuple[list, list]:
    """The base spans, and all spans."""
    base = base_spans(text)
    return base, sorted(base + random_spans(text, base, ratio, limit))


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secret_report(docs: DataFrame, vocabulary: str, pattern: str, limit: float = MAX_CHARS_PER_TOKEN) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random of every row of docs.

    Null texts are empty; texts without secrets have empty spans, and base_sha256 of the empty string. Positions
    are code points, ends exclusive. A narrow map: no shuffle. Other columns are ignored.
    """
    tuned(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = TokenEfficiency(vocabulary, pattern)
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                base, spans = scan(text or "", ratio, limit)
                n = [sum(k == kind for _, k, _ in spans) for kind in range(4)]
                rows.append((*n[:3], hashlib.sha256(shown(base).encode()).hexdigest(), shown(spans), n[3]))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"]
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": b.column("doc_id").cast(pa.int64())} | {n: pa.array(c, t) for n, c, t in zip(names, columns, types, strict=True)}
            )

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def redact(docs: DataFrame, vocabulary: str, pattern: str, limit: float = MAX_CHARS_PER_TOKEN) -> DataFrame:
    """docs with each secret replaced by [kind]; overlapping spans become one. All rows and columns stay.

    Null texts stay null; of other columns only n_chars, if there is one, follows the new text.
    """
    tuned(docs.sparkSession)
    names, schema = docs.columns, docs.schema

    def clean(text: str | None, ratio: TokenEfficiency) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for a, k, b in scan(text, ratio, limit)[1]:
            if a >= at:
                out += [text[at:a], f"[{KINDS[k]}]"]
            at = max(at, b)
        return "".join([*out, text[at:]]) if out else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = TokenEfficiency(vocabulary, pattern)
        for b in batches:
            at = b.schema.get_field_index("text")
            old = b.column(at).to_pylist()
            new = [clean(t, ratio) for t in old]
            columns = list(b.columns)
            columns[at] = pa.array(new, pa.string())
            if "n_chars" in names:
                k = b.schema.get_field_index("n_chars")
                counts = zip(columns[k].to_pylist(), old, new, strict=True)
                columns[k] = pa.array([n if t is s or t == s else len(s) for n, t, s in counts], columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, schema)
