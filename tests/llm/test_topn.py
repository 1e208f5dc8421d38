import math
import random

from corpusloom.llm import topn

SCHEMA = "q string, s double, r int, id long, place string"
ORDER = [("s", "descending"), ("r", "ascending"), ("id", "ascending")]


def brute(rows, n):
    out = set()
    for q in {r[0] for r in rows if r[0] is not None}:
        mine = [r for r in rows if r[0] == q and r[1] is not None and not math.isnan(r[1])]
        mine.sort(key=lambda r: (-r[1], r[2] is None, r[2] or 0, r[3]))
        out |= {(q, k + 1, r[3]) for k, r in enumerate(mine[:n])}
    return out


def test_loser_tree_merges_and_seeks():
    runs = [[(0, 1), (0, 3), (1, 0)], [(0, 2), (0, 4)], [], [(1, 1), (2, 0)]]
    ends = [[2, 2, 3], [2, 2], [], [1, 2]]
    got = [(runs[r][i], place) for r, i, place in topn.merge_top(runs, ends, 2)]
    assert got == [((0, 1), 1), ((0, 2), 2), ((1, 0), 1), ((1, 1), 2), ((2, 0), 1)]
    assert list(topn.merge_top([], [], 2)) == []


def test_equals_brute_force_with_a_hot_group_ties_nulls_and_nan(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(3000):
        q = rnd.choice(["hot"] * 4 + [f"q{k}" for k in range(40)] + ["", None])
        s = rnd.choice([None, float("nan"), *[k / 4 for k in range(5)], -0.0])
        rows.append((q, s, rnd.choice([None, 1, 2]), i, "x"))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for size in (1, 7, 10_000):
        got = topn.top_n(df.drop("place"), "q", ORDER, 5, run_rows=size, salts=3)
        assert {(r["q"], r["place"], r["id"]) for r in got.collect()} == brute(rows, 5)


def test_repeated_rows_count_as_rows_and_empty_gives_none(spark):
    df = spark.createDataFrame([("a", 1.0, 1, 1, "x")] * 3, SCHEMA)
    assert sorted(r["place"] for r in topn.top_n(df, "q", ORDER, 2).collect()) == [1, 2]
    assert topn.top_n(df.filter("false"), "q", ORDER, 2).count() == 0


def test_merges_stream_over_small_batches(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice(["hot", "hot", *[f"q{k}" for k in range(30)]]), rnd.choice([k / 3 for k in range(6)]), rnd.choice([None, 1, 2]), i, "x") for i in range(2000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("1", "7", "100"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = topn.top_n(df.drop("place"), "q", ORDER, 5, run_rows=50, salts=3)
            assert {(r["q"], r["place"], r["id"]) for r in got.collect()} == brute(rows, 5)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
