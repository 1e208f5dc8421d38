import pytest
from pyspark.sql import functions as F

from corpusloom.operators import checks, dedup, quantities, retrieval
from corpusloom.sources import files
from corpusloom.streaming import events as E


def test_first_wins_counts_copies_and_never_merges_unknown(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), (None, 3), (None, 4)], "k string, n int")
    got = sorted((r["k"] or "", r["n"], r["copies"]) for r in dedup.first_wins(df, ["k"], [F.col("n")]).collect())
    assert got == [("", 3, 1), ("", 4, 1), ("a", 1, 2)]
    assert dedup.first_wins(df.filter("false"), ["k"], [F.col("n")]).count() == 0


def test_upsert_counts_add_up(spark):
    stored = spark.createDataFrame([("a",), ("b",)], "k string")
    batch = spark.createDataFrame([("a", 1), ("c", 2), ("c", 3)], "k string, n int")
    rows, counts = dedup.upsert(stored, batch, "k", [F.col("n")])
    assert [tuple(r) for r in rows.collect()] == [("c", 2)]
    assert counts.first().asDict() == {"requested": 3, "new": 1, "present": 1, "duplicate": 1}


def test_kept_unless_seen_blocks_only_by_kept_rows(spark):
    df = spark.createDataFrame([("g", 1, "f1", "p1"), ("g", 2, "f1", "p2"), ("g", 3, "f2", "p2"), ("g", 4, None, None)], "g string, n int, f string, p string")
    assert sorted(r["n"] for r in dedup.kept_unless_seen(df, "g", ["n"], ["f", "p"]).collect()) == [1, 3, 4]


def test_merge_is_order_dependent_and_a_bridge_merges_nothing(spark):
    rows = [("r", 1, ["a"], 5), ("r", 2, ["b"], 5), ("r", 3, ["a", "b"], 99), ("r", 4, ["b"], 9), ("s", 5, ["a"], 1)]
    df = spark.createDataFrame(rows, "run string, seq int, keys array<string>, size int")
    got = {r["seq"]: (r["owner"], r["stands"]) for r in dedup.merged_candidates(df, "run", ["seq"], "seq", "keys", "size").collect()}
    # 3 joins the first of its two owners without replacing it; from then on b belongs to it
    assert got == {1: (0, True), 2: (1, True), 3: (0, False), 4: (0, True), 5: (0, True)}


def test_latest_found_by_numbered(spark):
    df = spark.createDataFrame([("k", 1, "x"), ("k", 3, "y"), ("k", 2, "x")], "k string, n int, w string")
    assert dedup.latest(df, ["k"], [F.col("n")]).first()["w"] == "y"
    assert dedup.found_by(df, "k", "w", "n").first()["finders"] == ["x", "y"]
    assert [r["position"] for r in dedup.numbered(df, "k", [F.col("n")]).orderBy("n").collect()] == [0, 1, 2]


def test_top_k_matches_brute_force_with_ties(spark):
    items = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(20)], "item_id long, vector array<double>")
    queries = spark.createDataFrame([(7, [1.0, 1.0]), (8, [0.0, 0.0])], "query_id long, vector array<double>")
    got = [(r["query_id"], r["item_id"]) for r in retrieval.top_k_similar(queries, items, 3).orderBy("query_id", "place").collect()]
    assert got == [(7, 1), (7, 4), (7, 7), (8, 0), (8, 1), (8, 2)]
    blocks = retrieval.top_k_similar(queries, items, 3, query_block=1, item_block=4)
    assert [(r["query_id"], r["item_id"]) for r in blocks.orderBy("query_id", "place").collect()] == got
    assert retrieval.top_k_similar(queries.filter("false"), items, 3).count() == 0


def test_mmr_prefers_variety_and_first_of_equals():
    q = [1.0, 0.0]
    assert retrieval.mmr(q, [[1.0, 0.0], [1.0, 0.0], [0.7, 0.7]], 2, 0.3) == [0, 2]
    assert retrieval.mmr(q, [[1.0, 0.0], [1.0, 0.0]], 5) == [0, 1]
    assert retrieval.mmr(q, [], 3) == []
    assert retrieval.greedy_leaders([[1, 0], [1, 0.01], [0, 1]], 0.9, 5) == [0, 2]


def test_source_cap_backfills(spark):
    df = spark.createDataFrame([("q", "a", i) for i in range(4)] + [("q", "b", 9)], "q string, s string, n int")
    got = [r["n"] for r in retrieval.capped_per_source(df, "q", "s", [F.col("n")], 2, 4).orderBy("place").collect()]
    assert got == [0, 1, 9, 2]


def test_labels_and_allocation(spark):
    df = spark.createDataFrame([("r", "x", 3), ("r", "y", 1), ("r", "x", 2)], "r string, s string, n int")
    assert {r["s"]: r["label"] for r in retrieval.first_use_labels(df, "r", "s", "n").collect()} == {"y": "S1", "x": "S2"}
    q = spark.createDataFrame([("r", 0, 1), ("r", 1, 2), ("r", 0, 3)], "r string, core int, n int")
    assert [r["passages"] for r in retrieval.allocated(q, "r", "core", "n", 8).orderBy("n").collect()] == [3, 3, 2]


def test_checks(spark):
    df = spark.createDataFrame([(1, 5, "p"), (2, -1, "q"), (2, None, None)], "id int, n int, ref string")
    got = {(r["rule"], r["key"]) for r in checks.breaking(df, {"n_positive": F.col("n") > 0}, "id").collect()}
    assert got == {("n_positive", "2")}
    assert checks.repeated(df, ["id"], "unique").first()["key"] == "2"
    parent = spark.createDataFrame([("p",)], "k string")
    assert [r["key"] for r in checks.dangling(df, "ref", parent, "k", "fk").collect()] == ["q"]
    s = spark.createDataFrame([("u", 1, "new"), ("u", 2, "done"), ("v", 1, "done")], "u string, t int, s string")
    bad = checks.transitions(s, "u", ["t"], "s", [(None, "new"), ("new", "done")]).collect()
    assert [(r["u"], r["s"]) for r in bad] == [("v", "done")]


def _amount(value, per=None, period=None, approximate=False, dimension="mass", unit="g", stated=None, baseline=None, method=None, scope=None):
    return (value, value, value, 1.0, approximate, dimension, unit, stated, per, period, baseline, method, scope)


@pytest.mark.parametrize(
    ("a", "b", "expected"),
    [
        (_amount(10.0), _amount(11.0), "agree"),
        (_amount(10.0), _amount(13.0), "unresolved"),
        (_amount(10.0, period=["y2010"], scope=["adults"]), _amount(13.0, period=["y2010"], scope=["adults"]), "disagree"),
        (_amount(10.0, period=["y2010"], scope=["adults"], method=["trial"]), _amount(13.0, period=["y2010"], scope=["adults"]), "unresolved"),
        (_amount(10.0, scope=["adults"]), _amount(10.0, scope=["men"]), "different_scope"),
        (_amount(10.0, baseline=["placebo"]), _amount(10.0, baseline=["control"]), "different_period"),
        (_amount(10.0, period=["y2010"]), _amount(10.0, period=["d5week"]), "agree"),
        (_amount(10.0, unit="g", stated="10"), _amount(10000.0, unit="kg", stated="10"), "different_measure"),
        (_amount(10.0, per=["day", "kg"]), _amount(10.0, per=["kg"]), "agree"),
        (_amount(100.0, approximate=True), _amount(105.0), "agree"),
        (_amount(10.0, per=["day"]), _amount(10.0), "different_measure"),
        (_amount(10.0, dimension="energy"), _amount(10.0), "different_measure"),
        (_amount(10.0, period=["y2010"]), _amount(10.0, period=["y2011"]), "different_period"),
        (_amount(10.0, period=["y2010"]), _amount(10.0), "agree"),
        (_amount(None), _amount(1.0), "unresolved"),
    ],
)
def test_pair_class(spark, a, b, expected):
    t = "struct<value:double,low:double,high:double,step:double,approximate:boolean,dimension:string,unit:string,stated:string,per:array<string>,period:array<string>,baseline:array<string>,method:array<string>,scope:array<string>>"
    df = spark.createDataFrame([(a, b)], f"a {t}, b {t}")
    assert df.select(quantities.pair_class(F.col("a"), F.col("b")).alias("c")).first()["c"] == expected


def test_nearest_by_relative_gap(spark):
    left = spark.createDataFrame([("m", 1, 10.0), ("m", 2, 100.0), ("e", 3, 5.0)], "k string, n int, v double")
    right = spark.createDataFrame([("m", 8, 9.0), ("m", 9, 90.0)], "k string, n int, v double")
    got = {(r["n"], r["other_n"]) for r in quantities.nearest(left, right, ["k"], "v", "n").collect()}
    assert got == {(1, 8), (2, 9)}


def test_manifest_progress_csv_and_markdown(spark, tmp_path):
    items = spark.createDataFrame([("a", None), ("b", 2)], "id string, n int")
    files.write_manifest(items, "id", "v1", str(tmp_path / "m"))
    manifest = spark.read.json(str(tmp_path / "m"))
    assert files.frozen(items.orderBy(F.desc("id")), "id", "v1", manifest).count() == 2
    with pytest.raises(ValueError, match="manifest"):
        files.frozen(items.limit(1), "id", "v1", manifest)
    for n in (1, 2):
        files.append_progress(spark.createDataFrame([("c", n)], "cell string, at int"), str(tmp_path / "log"))
    assert [tuple(r) for r in files.resume(spark, str(tmp_path / "log"), "cell string, at int", "cell", "at").collect()] == [("c", 2)]
    files.write_csv(items, ["id"], str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    assert files.file_hashes(spark, str(tmp_path / "csv" / "*.csv")).count() >= 1
    assert files.markdown(items.orderBy("id")).splitlines()[2] == "| a | — |"
    (tmp_path / "set.json").write_text('{"name": "d", "version": "1", "items": [{"id": "x"}, {"id": "y"}]}')
    assert files.load_set(spark, str(tmp_path / "set.json"), "id:string").count() == 2


def test_streams_on_files(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 7, "view", 1.0, None), (1, "2024-01-01 00:01:00", 7, "view", 1.0, None), (2, "2024-01-01 00:05:00", 7, "click", 2.0, None), (3, "2024-01-01 09:00:00", 7, "view", 3.0, None)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    assert E.windowed(df, "1 hour").count() == 3
    assert sorted(r["events"] for r in E.sessions(df).collect()) == [1, 3]

    def run(frame, name):
        q = frame.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    assert sorted(r["event_id"] for r in run(E.first_only(E.read_events(spark, str(tmp_path / "in"))), "first")) == [1, 2, 3]
    slots = [r["slot"] for r in run(E.rate_limited(E.read_events(spark, str(tmp_path / "in")), 600.0), "slots")]
    assert len(slots) == 4 and sorted(slots)[1] - sorted(slots)[0] >= 600


def test_vectors_of_different_widths_are_an_error(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0])], "item_id long, vector array<double>")
    queries = spark.createDataFrame([(7, [1.0, 1.0])], "query_id long, vector array<double>")
    with pytest.raises(ValueError, match="widths"):
        retrieval.top_k_similar(queries, items, 3)


def test_facets_of_a_text(spark):
    from corpusloom.operators import facets

    text = "In a trial from 2010–2015 and again in 2019, over 12 weeks, 5 mg per day against 7 mg/kg; lower than placebo in adults."
    f = spark.createDataFrame([(text,), ("nothing",)], "t string").select(facets.facets(F.col("t")).alias("f")).select("f.*", facets.context_tokens(F.col("f")).alias("tokens")).collect()
    assert f[0]["period"] == ["d12week", "y2010-2015", "y2019"] and f[0]["per"] == ["day", "kg"] and f[0]["baseline"] == ["placebo"] and f[0]["method"] == ["trial"] and f[0]["scope"] == ["adults"]
    assert f[1]["period"] is None and f[1]["tokens"] == [] and "per:kg" in f[0]["tokens"]


def test_a_set_s_fingerprint_does_not_depend_on_order_or_partitions(spark):
    rows = [(f"k{i}", i) for i in range(300)]
    a = files.set_fingerprint(spark.createDataFrame(rows, "id string, n int"), "id").first()
    b = files.set_fingerprint(spark.createDataFrame(rows[::-1], "id string, n int").repartition(7), "id").first()
    c = files.set_fingerprint(spark.createDataFrame(rows[1:], "id string, n int"), "id").first()
    assert a == b and a["items"] == 300 and c["sha256"] != a["sha256"]


def test_owners_of_a_facet(spark):
    from corpusloom.operators import facets

    text = "😀 In 2010 it was 5% and 7% in 2011, then 9%."
    row = spark.createDataFrame([(text,)], "t string").select(facets.places(F.col("t"), facets.PERCENT).alias("m"), facets.places(F.col("t"), facets.YEAR).alias("y"), "t")
    got = row.select("m", "y", F.transform("y", lambda y: facets.owners(y, F.col("m"))).alias("o"), F.transform("y", lambda y: facets.owners(y, F.col("m"), True)).alias("p"), facets.covering(F.col("t"), F.lit("7% in"), F.col("m")).alias("c")).first()
    assert [text[r["start"] : r["end"]] for r in got["m"]] == ["5%", "7%", "9%"]
    assert got["o"] == [["5%", "7%", "9%"], ["7%"]] and got["p"] == [["5%"], ["7%"]] and got["c"]["value"] == "7%"
