import os
import random
from collections import Counter

import pytest

from corpusloom.llm import mixing, packing, tokens

needs_tokenizer = pytest.mark.skipif(not os.path.exists(tokens.TOKENIZER), reason="no tokenizer file")


def test_pack_places_all_within_capacity():
    rnd = random.Random(1)
    items = [(rnd.choice([0, 5, 40, 100, 300, 512, rnd.randrange(1, 2048)]), (k,)) for k in range(3000)]
    made = packing.pack(items, [512, 2048])
    assert Counter(i for _, m in made for _, i in m) == Counter(i for _, i in items)
    assert all(sum(s for s, _ in m) <= cap for cap, m in made)
    used = sum(s for s, _ in items) / sum(cap for cap, _ in made)
    assert used > 0.95  # these sizes do not fill their tiers exactly
    assert packing.pack([], [10]) == []


def test_gaps_of_long_windows_take_short_items():
    made = packing.pack([(90, "a"), (10, "b"), (10, "c")], [10, 100])
    assert sorted((cap, sum(s for s, _ in m)) for cap, m in made) == [(10, 10), (100, 100)]


def test_step_groups_are_even():
    loads = [10, 9, 8, 3, 2, 1, 7, 7]
    groups = packing.deal(loads, 4)
    sums = [sum(x for x, g in zip(loads, groups, strict=True) if g == k) for k in (0, 1)]
    assert Counter(groups) == {0: 4, 1: 4} and abs(sums[0] - sums[1]) <= 3
    assert packing.deal([], 4) == []


@needs_tokenizer
def test_hierarchical_over_a_table(spark):
    rnd = random.Random(2)
    rows = [(k, "word " * rnd.choice([1, 30, 200, 900]), "s", k) for k in range(300)] + [(900, "long text here " * 9000, "s", 0), (901, None, None, 0), (902, "", "s", 0), (None, "x", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, tokens int")
    kinds = spark.createDataFrame([("short", 512), ("large", 2048)], "container_kind string, capacity_tokens int")
    got = packing.hierarchical(docs, kinds, shard=100).collect()
    size = {r["doc_id"]: r["tokens"] for r in tokens.token_counts(docs).collect()}
    per = Counter()
    for r in got:
        per[r["doc_id"]] += r["tokens"]
    assert dict(per) == size
    load = Counter()
    for r in got:
        load[r["container_id"], r["capacity_tokens"]] += r["tokens"]
    assert all(v <= cap for (_, cap), v in load.items())
    split = {d for d, n in Counter(r["doc_id"] for r in got).items() if n > 1}
    assert split == {900} and size[900] > 2048
    assert packing.hierarchical(docs, kinds.filter("false")).count() == 0
    report = packing.fill_report(packing.by_capacity(docs, kinds)).collect()
    assert {r["container_kind"] for r in report} == {"short", "large"} and all(0 < r["fill"] <= 1 for r in report)


def test_water_fill():
    e = mixing.water_fill({"a": 100, "b": 10, "c": 0}, {"a": 0.5, "b": 0.5, "c": 0.1}, {"a": 4, "b": 2, "c": 3}, 110)
    assert e["b"] == 2 and abs(e["a"] - 0.9) < 1e-9 and e["c"] == 0
    assert mixing.water_fill({"a": 10}, {"a": 1.0}, {"a": 2}, 1000) == {"a": 2.0}
    assert mixing.water_fill({}, {}, {}, 5) == {}
    assert mixing.water_fill({"a": 10}, {"a": -1.0}, {"a": 2}, 5) == {"a": 0.0}


@needs_tokenizer
def test_mixture_over_a_table(spark):
    rows = [(k, f"some words of text number {k}", "big" if k % 3 else "small", 1) for k in range(900)] + [(9999, "", "big", 1), (None, "x", "big", 1), (9998, "text", None, 1), (9997, "text", "elsewhere", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, bucket int")
    targets = spark.createDataFrame([("m", "big", 0.2, 4), ("m", "small", 0.8, 2), ("m", "absent", 0.1, 2)], "mix_name string, source string, target_share double, max_repeats int")
    mixed = mixing.mixture(docs, targets)
    got = mixed.collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mixture(docs.repartition(7), targets).collect()))
    size = Counter()
    for r in got:
        size[r["source"]] += r["tokens"] * r["repeats"]
    total = sum(r["tokens"] for r in tokens.token_counts(docs.filter("source in ('big', 'small')")).collect())
    assert abs(sum(size.values()) - total) / total < 0.02
    assert max(r["repeats"] for r in got if r["source"] == "small") == 2
    report = {r["source"]: r for r in mixing.mix_report(mixed, targets).collect()}
    assert report["absent"]["documents"] == 0 and abs(sum(r["actual_share"] for r in report.values()) - 1) < 1e-5
    assert mixing.mixture(docs.filter("false"), targets).count() == 0


def test_largest_budget_meets_every_share():
    sizes, weights, caps = {"a": 100, "b": 10}, {"a": 0.5, "b": 0.5}, {"a": 4, "b": 2}
    room = mixing.largest_budget(sizes, weights, caps)
    e = mixing.water_fill(sizes, weights, caps, room)
    assert room == 40 and e == {"a": 0.2, "b": 2.0}
    assert mixing.largest_budget({}, weights, caps) == 0


@needs_tokenizer
def test_the_largest_budget_gives_the_target_shares(spark):
    docs = spark.createDataFrame([(k, f"some words of text number {k}", "big" if k % 3 else "small") for k in range(900)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("m", "big", 0.2, 4), ("m", "small", 0.8, 2)], "mix_name string, source string, target_share double, max_repeats int")
    report = {r["source"]: r for r in mixing.mix_report(mixing.mixture(docs, targets, budget="largest"), targets).collect()}
    assert all(abs(r["actual_share"] - r["target_share"]) < 0.01 for r in report.values())
    assert report["small"]["clamped"] and not report["big"]["clamped"]
