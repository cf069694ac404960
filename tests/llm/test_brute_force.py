"""Whole queries that SQL can't express, against plain versions over all rows of the smallest tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
from helpers import SF

from rasterflow.llm import decontaminate, quality_rules, secrets
from rasterflow.llm.queries import BYTE_BPE, PATTERN, PIECES, QUERIES

BLANK = r"[\x20\x09-\x0D]+"
KINDS = {
    "assign": r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}


def base(text):
    long = {"assign": lambda m: len(m[1]) >= 12, "access": lambda m: len(m[0]) >= 18, "hex": lambda m: len(m[0]) >= 16}
    spans = [(m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(KINDS.items()) for m in re.finditer(p, text) if long[kind](m)]
    return [(kind, a, b) for a, _, kind, b in sorted(spans)]


def shown(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_secret_scan(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op5_secret_scan"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base(texts[r.doc_id])
        n = Counter(k for k, _, _ in want)
        assert (r.n_assign, r.n_access, r.n_hex) == (n["assign"], n["access"], n["hex"])
        assert r.base_sha256 == hashlib.sha256(shown(want).encode()).hexdigest()
        assert {s for s in r.spans.split(",") if not s.startswith("random:")} - {""} == {f"{k}:{a}:{b}" for k, a, b in want}


def passes(text):
    words = [w for w in re.split(BLANK, text) if w]
    lines = [x for x in text.split("\n") if re.sub(BLANK, "", x)]
    grams = list(zip(words, words[1:], words[2:], strict=False))
    twice = {g for g, n in Counter(grams).items() if n > 1}
    repeat = len({i + k for i, g in enumerate(grams) if g in twice for k in range(3)})
    if len(words) < 50 or 100 * repeat > 50 * len(words):
        return False
    stop = {*quality_rules.STOP_WORDS, *(w.capitalize() for w in quality_rules.STOP_WORDS)}
    m = {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(text.count(c) for c in quality_rules.SYMBOLS), "n_shouts": text.count("!"),
        "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_distinct_words": len(set(words)), "n_stop_words": sum(w in stop for w in words),
    }
    return all(r.low * m[r.bottom] <= m[r.top] and (m[r.bottom] == 0 or m[r.top] <= r.high * m[r.bottom]) for r in quality_rules.RULES)


def one_of_each(docs, width=5, percent=80):
    sets = {}
    for d, t in docs.items():
        w = t.encode().lower().split()
        sets[d] = {tuple(w[i : i + min(width, len(w))]) for i in range(len(w) - min(width, len(w)) + 1)} if w else set()
    where, comp = {}, {d: d for d in docs}
    for d, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(d)

    def top(d):
        while comp[d] != d:
            d = comp[d]
        return d

    shared = Counter((a, b) for ds in where.values() for a in ds for b in ds if a < b)
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            low, high = sorted((top(a), top(b)))
            comp[high] = low
    return {d: t for d, t in docs.items() if top(d) == d}


def decontaminated(text, windows):
    word = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
    raw = text.encode()
    seq, hit = decontaminate.words(text), set()
    for n, known in windows.items():
        for i in range(len(seq) - n + 1):
            if tuple(seq[i : i + n]) in known:
                hit |= set(range(i, i + n))
    if hit and 20 * len(hit) >= len(seq):
        return None
    at = [m.span() for m in word.finditer(raw)]
    for end in sorted((i for i in hit if i + 1 not in hit), reverse=True):
        begin = end
        while begin - 1 in hit:
            begin -= 1
        if end - begin + 1 > 50:
            raw = raw[: at[begin][0]] + raw[at[end][1] :]
    return raw.decode()


def redacted(text, ratio):
    found = [(a, k, b) for k, a, b in base(text)]
    plain = [(a, secrets.KINDS.index(k), b) for a, k, b in found]
    found = sorted([*plain, *secrets.random_spans(text, plain, ratio)])
    out, at = "", 0
    for a, k, b in found:
        if a >= at:
            out += text[at:a] + f"[{secrets.KINDS[k]}]"
        at = max(at, b)
    return out + text[at:]


def test_pipeline(spark):
    import sentencepiece

    import corpus_pipeline

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    total = len(docs)
    docs = one_of_each({d: t for d, t in docs.items() if passes(t)})
    windows: dict = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = decontaminate.words(r.text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows.setdefault(n, set()).add(tuple(w[i : i + n]))
    clean = {d: x for d, t in docs.items() if (x := decontaminated(t, windows)) is not None}
    assert 0 < len(clean) < len(docs) < total
    ratio = secrets.TokenEfficiency(BYTE_BPE, PATTERN)
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = {d: sp.encode(redacted(t, ratio)) for d, t in clean.items()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert len(got) == len(want) and {r.doc_id: r.ids for r in got} == want
    assert all(r.n_ids == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
