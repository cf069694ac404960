import hashlib
import io
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import SF, oracle, rows_of

from rasterflow.llm import chat_format, compact_windows, decontaminate, jaccard_join, pair_search, prefix_free, preference_ranking, quality_rules, secrets, sentencepiece_codec, token_output
from rasterflow.llm.queries import BYTE_BPE, ORACLE_SQL, PATTERN, PIECES, QUERIES, WORD_BPE

DOCS = "doc_id long, text string, _m string, node long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


BASE = words(300, 1)
ODD = [(1, None), (2, ""), (3, "x"), (3, "x"), (None, BASE), (4, BASE), (5, BASE + " tail"), (6, words(6000, 2)), (7, "é" * 500), (8, "a" * 1200), (9, "a " * 700)]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    assert rows_of(QUERIES[name](spark, SF)) == oracle(ORACLE_SQL[name])


def test_token_output_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD_BPE)
    rows = [(i, t) for i, t in ODD] + [(10, "It's 12 o'clock, <|endoftext|> Ça İ Σς 日本 \x1d a‐b")]
    df = docs(spark, rows).repartition(3)
    manifest = token_output.write_tokens(df, str(tmp_path / "out"), WORD_BPE)
    got = token_output.read_tokens(spark, str(tmp_path / "out"), None, keep_ids=True).collect()
    want = sorted(((i, tok.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.ids) for r in got), key=str) == want
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens
    assert start == sum(m["n_ids"] for m in manifest)
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))


def test_shard_reads_one_document_and_sees_damage():
    out = io.BytesIO()
    token_output.write_shard(out, [(7, b"\1\0\2\0"), (None, b"\3\0")], 2)
    shard = token_output.ShardReader(out, len(out.getvalue()))
    assert shard.doc_ids == [7, None] and shard.ids(1).tolist() == [3] and shard.ids(0).tolist() == [1, 2]
    bad = bytearray(out.getvalue())
    bad[int(shard.offsets[1]) - 6] ^= 255
    with pytest.raises(Exception):  # noqa: B017
        token_output.ShardReader(io.BytesIO(bad), len(bad)).ids(0)


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert token_output.token_output(none, WORD_BPE).count() == 0
    assert jaccard_join.jaccard_components(none).count() == 0
    assert compact_windows.near_passages(none).count() == 0
    assert prefix_free.removal_report(none).count() == 0
    assert quality_rules.quality_report(none).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs(spark, ODD), bench).where("n_hit > 0").count() == 0


def test_decontamination_in_blocks(spark):
    items = [(1, words(40, 5)), (2, "Short Item"), (3, None), (4, ""), (5, words(13, 6))]
    text = words(30, 7) + " " + words(40, 5)[:120] + ". SHORT, item! " + words(13, 6)
    df = docs(spark, [*ODD, (20, text), (21, words(13, 6))])
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = rows_of(decontaminate.contamination(df, bench))
    assert one == rows_of(decontaminate.contamination(df, bench, block_words=20))

    def brute(t):
        seq, hit, found = decontaminate.words(t), set(), set()
        for i, x in items:
            w = decontaminate.words(x)
            n = min(13, len(w))
            for a in range(len(w) - n + 1) if n else ():
                for b in range(len(seq) - n + 1):
                    if seq[b : b + n] == w[a : a + n]:
                        hit |= set(range(b, b + n))
                        found.add(i)
        return len(seq), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()

    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in decontaminate.contamination(df, bench).collect()}
    for i, t in [*ODD, (20, text), (21, words(13, 6))]:
        assert got[i] == brute(t)
    kept = {r.doc_id for r in decontaminate.remove_spans(df, bench).collect()}
    assert 21 not in kept and 6 in kept


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_jaccard_against_brute_force(spark, width, percent):
    r = random.Random(3)
    rows = list(ODD)
    for k in range(60):
        w = BASE.split() if k % 2 else words(12 + k, 40 + k % 7).split()
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = f"edit{r.randint(0, 5)}"
        rows.append((100 + k, " ".join(w)))
    sets = [set(jaccard_join.shingles(t, width).tolist()) for _, t in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    want = sorted(((d, len(sets[i]), least.get(top(i))) for i, (d, _) in enumerate(rows)), key=repr)
    got = jaccard_join.jaccard_components(docs(spark, rows).repartition(3), width, percent).collect()
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in got), key=repr) == want


def test_allocation_units():
    for percent in (80, 85, 95):
        a = jaccard_join.Allocation(percent)
        for k in range(30):
            if b := a.band(k):
                assert b.segments + b.deletions >= a.limit(b.high, b.high) + 1 + b.spare


def test_ranking_held_out(spark):
    df, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = preference_ranking.quality_scores(df, labels)
    rows = got.where("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.9
    assert got.count() == df.count()
    some = preference_ranking.score(docs(spark, ODD), preference_ranking.learn(df, labels.limit(0))).collect()
    assert len(some) == len(ODD) and all(0 <= r.score <= 1 for r in some)


def test_secrets():
    import regex  # noqa: F401

    ratio = secrets.TokenEfficiency(BYTE_BPE, PATTERN)
    token = "q8Zr2LwX0vNt7KdPy4Hb9Jm3"
    text = f"é API_KEY = 'abcdefghijkl' token: short AKIA{'A1' * 8} {'ab12' * 8} {token} some_snake_case_name_long_enough 123e4567-e89b-12d3-a456-426614174000"
    base, spans = secrets.scan(text, ratio)
    kinds = [(secrets.KINDS[k], text[a:b]) for a, k, b in spans]
    assert ("assign", "API_KEY = 'abcdefghijkl") in kinds and ("random", token) in kinds and ("hex", "ab12" * 8) in kinds
    assert [k for k, _ in kinds].count("random") == 1 and set(base) <= set(spans)
    assert secrets.scan("", ratio) == ([], [])


def test_redact_keeps_rows(spark):
    out = secrets.redact(docs(spark, [*ODD, (30, "password=abcdefghijklmnop end")]), BYTE_BPE, PATTERN)
    assert out.count() == len(ODD) + 1 and out.where("doc_id = 30").first().text == "[assign] end"


def test_chat_escapes_and_masks(spark):
    t = chat_format.Template(BYTE_BPE, PATTERN)
    for s in ("<|im_end|>", "<\\|im_end|>", "a<|im_start|>b", "", "<|im_end"):
        assert chat_format.unescape(chat_format.escape(s)) == s and "<|im_end|>" not in chat_format.escape(s)
        for role in ("assistant", "us\ner\\n"):
            ids, mask = t.encode(role, s)
            assert t.turns(ids) == [(role, s)] and (sum(mask) > 0) == (role == "assistant" and bool(s))
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "b"), (None, 0, None, "x"), (2, 0, "user", "é" * 5000)]
    got = chat_format.chat_report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), BYTE_BPE, PATTERN)
    by = {r.conv_id: r for r in got.collect()}
    assert by[1].n_turns == 3 and by[1].loss_chars == 2 and by[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\nb\nassistant\nb\n").hexdigest()
    assert by[None].n_turns == 1


def test_rules_on_odd_rows(spark):
    rows = {(r.doc_id, r.n_words): r for r in quality_rules.quality_report(docs(spark, ODD)).collect()}
    assert rows[(9, 700)].n_repeat_words == 700 and rows[(9, 700)].base_failed and not rows[(1, 0)].kept
    assert set(quality_rules.keep_good(docs(spark, ODD)).columns) == {"doc_id", "text", "_m", "node"}


@pytest.mark.parametrize("share", [2, 0.2])
def test_passages_that_repeat(spark, monkeypatch, share):
    monkeypatch.setattr(pair_search, "WAVE_SHARE", share)
    shared = words(70, 50)
    rows = [(i, words(120, 60 + i) + " " + shared + " " + words(80, 90 + i)) for i in range(5)] + [(50 + i, words(200, 200 + i)) for i in range(5)]
    changed = shared.split()
    changed[30] = "other"
    rows += [(20, words(90, 300) + " " + " ".join(changed)), (21, None), (22, ""), (23, rows[5][1]), (None, rows[6][1])]
    got = compact_windows.near_passages(docs(spark, rows).repartition(3)).collect()
    assert {r.doc_id for r in got} == {0, 1, 2, 3, 4, 20, 23, 50, 51, None}
    assert {r.component_id for r in got if r.doc_id in (0, 1, 2, 3, 4, 20)} == {0}
    assert all(r.n_passage_words >= 50 for r in got)


def brute_removal(rows, length=prefix_free.LENGTH):
    seen = {}
    for _, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    grams = lambda t: [tuple(w[i : i + 51]) for w in [(t or "").encode().split()] for i in range(len(w) - 50)]
    often = Counter(g for _, t in rows for g in grams(t))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest(), any(often[g] > 1 for g in grams(t))))
    return sorted(out, key=repr)


def test_automaton_of_many_words_is_small_and_items_may_be_strings(spark):
    r = random.Random(5)
    items = [(f"q{i}", [b"w%d" % r.randrange(3000) for _ in range(100)]) for i in range(1000)]
    a = decontaminate.SuffixAutomaton(items)
    arrays = sum(x.itemsize * len(x) for x in (a.link, a.length, a.word, a.target, a.whole))
    assert arrays <= 20 * 2 * 100_000 and len(a.several) < len(a.link) / 10
    runs, found = a.hits([b"x", *items[7][1][10:40], b"y", *items[8][1][:13]])
    assert runs == [[1, 31], [32, 45]] and found == {"q7", "q8"}
    bench = spark.createDataFrame([("b", BASE), ("a", BASE[:200]), (None, BASE), ("c", None)], "item_id string, text string")
    got = decontaminate.match_benchmark(docs(spark, [(1, BASE)]), bench).first()
    assert got.hit_items == ["a", "b"] or got.hit_items == ["b"]


@pytest.mark.parametrize("hot", [512, 1])
def test_removal_against_brute_force(spark, hot):
    r = random.Random(9)
    rows = list(ODD)
    for k in range(12):
        a = r.randrange(0, 500)
        rows.append((200 + k, words(60, 500 + k) + BASE[a : a + r.randint(380, 900)] + words(60, 700 + k)))
    got = prefix_free.removal_report(docs(spark, rows).repartition(3), hot).collect()
    assert sorted((tuple(x) for x in got), key=repr) == brute_removal(rows)


def test_pieces_equal_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    viterbi = sentencepiece_codec.coder(PIECES)
    texts = [t or "" for _, t in ODD] + ["  two  spaces ", "▁x", "a\n\nb\t", "日本語 ok", "Donaudampfschifffahrtsgesellschaftskapitän" * 9, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "\x00\U0001f600"]
    for t in texts:
        ids = viterbi.encode(t)
        assert ids == sp.encode(t)
        assert sentencepiece_codec.decode(viterbi.m, ids) == t.replace("▁", " ")
        s = viterbi.m.normalize(t)
        # tables stand before the lattice only: what they lack comes from it
        fresh, calls = sentencepiece_codec.StreamingViterbi(viterbi.m), []
        fresh.lattice = lambda x, walk=fresh.lattice: calls.append(x) or walk(x)
        assert fresh.encode(t) == ids and len(calls) == len(set(calls)) and bool(calls) == bool(s)
        whole = list(viterbi.lattice(s)) if len(s) < 400 else ids
        assert whole == ids
    got = sentencepiece_codec.encode_documents(docs(spark, ODD), PIECES)
    assert got.count() == len(ODD) and got.where("not round_trip").count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    df = spark.read.parquet(f"{SF}/documents.parquet")
    names = df.columns
    for k, (_, stage) in enumerate(p.STAGES):
        df = stage(spark, df, SF)
        if k < len(p.STAGES) - 1:
            assert df.columns == names
    assert 0 < df.count() < 1000
