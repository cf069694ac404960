import random

from rasterflow.llm.jaccard_join import keep_one


def text(seed):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(10**9)}" for _ in range(60))


def test_rows_of_a_repeated_id(spark):
    a, b, c = text(1), text(2), text(3)
    rows = [(1, a), (5, a), (5, b), (5, b), (6, b), (7, c), (7, c + " tail"), (7, c), (8, ""), (8, None), (None, a), (9, text(4))]
    out = keep_one(spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, node long, _m string").repartition(3))
    assert out.columns == ["doc_id", "text", "node", "_m"]
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    assert got == sorted([(1, a), (5, b), (7, c), (8, ""), (8, None), (None, a), (9, text(4))], key=repr)
