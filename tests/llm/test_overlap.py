import random
from collections import Counter

from corpusloom.llm import overlap


def items(spark, rows):
    return spark.createDataFrame([(i, s, q, "c", "o", "clash") for i, s, q in rows], "question_id string, set_name string, question string, category string, origin string, norm string")


def pairs(df):
    return {tuple(r) for r in df.collect()}


def test_chunks_are_the_text_and_an_edit_moves_few():
    text = "does fermented oat bread from brafatrind change speech clarity in cancer survivors"
    chunks = overlap.cut_points(text)
    assert "".join(chunks) == text
    other = overlap.cut_points(text.replace("speech", "speeech"))
    assert len(set(chunks) - set(other)) <= 3
    assert overlap.cut_points("") == []


def test_replacements_of_two_wordings():
    r = overlap.replaced
    q = "does kelp tea from brafatrind change fall risk in older adults"
    assert r(q, "does kelp tea from brafatrind alter fall risk in older adults") == [("change", "alter", False)]
    assert r(q, "in older adults does kelp tea from brafatrind change fall riisk") == [("risk", "riisk", True)]
    assert r(q, "please explain " + q) == [("", "please explain", False)]
    assert r(q, q.replace("older adults", "adults")) == [("older", "", False)]
    assert r(q, q.replace("kelp tea", "kelptea")) == []
    assert r("over 75 people", "over 65 people") == [("75", "65", False)]
    assert r("does tea and milk help", "does tea and milk help and why") == [("", "and why", False)]
    assert r("what led to it", "according to recent research what led to it") == [("", "according to recent research", False)]


def brute(rows):
    """The rule of the module over all pairs across splits, in plain Python."""
    can = sorted({(i, s, overlap.normalised(q)) for i, s, q in rows if i and s and overlap.normalised(q)})
    texts = {(s == "development", n) for _, s, n in can if s in ("development", "validation", "test")}
    shown, kept, counts = {}, {}, Counter()
    for _, n in texts:
        w = n.split()
        counts.update({*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))})
    for left, a in texts:
        for right, b in texts:
            if not left or right:
                continue
            x, y = dict.fromkeys(overlap.cut_points(a)), dict.fromkeys(overlap.cut_points(b))
            both = sum(map(len, x.keys() & y.keys()))
            diffs = overlap.replaced(a, b)
            short = 0 if len(a.split()) <= len(b.split()) else 1
            other = sum(len(t[short].split()) for t in diffs if not t[2])
            if both < overlap.LEAST * min(sum(map(len, x)), sum(map(len, y))) or other > (1 - overlap.WORDS) * min(len(a.split()), len(b.split())):
                continue
            kept[a, b] = diffs
            if len(diffs) <= overlap.FEW:
                for t in diffs:
                    x, y = sorted(t[:2])
                    with_x, with_y = shown.setdefault((x, y), (set(), set()))
                    with_x.add(a if t[0] == x else b)
                    with_y.add(b if t[0] == x else a)

    def fine(t):
        x, y = sorted(t[:2])
        dx = min((counts[w] for w in x.split()), default=None)
        w = y.split()
        dy = min(counts[v] for v in (w if x else [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]))
        m, most = min(dy, dy if dx is None else dx), max(dy, dx or 0)
        with_x, with_y = shown.get((x, y), ((), ()))
        n = len(with_y if dx is None or dy <= dx else with_x)
        p, z = min(1.0, n / m), overlap.Z
        low = (p + z * z / 2 / m - z * max(0.0, p * (1 - p) / m + z * z / 4 / m / m) ** 0.5) / (1 + z * z / m)
        return (t[2] and m <= max(2, most / 20)) or (low >= overlap.SURE and (not x or (n >= overlap.SEEN and most >= overlap.RATIO * m)))

    same = {p for p, diffs in kept.items() if all(map(fine, diffs))}
    return {(i, j) for i, s, a in can for j, t, b in can if s == "development" and t in ("validation", "test") and (a, b) in same}


def test_equals_brute_force(spark):
    rnd = random.Random(3)
    name = lambda: "".join(rnd.choice("bdfgklmnprstv") + rnd.choice("aeiou") for _ in range(4))
    rows = []
    for k in range(240):
        q = f"Does {rnd.choice(['kelp tea', 'soy gel', 'cold showers', 'kelp juice', 'mint juice'])} from {name()} change {rnd.choice(['fall risk', 'bone density', 'grip'])} in {rnd.choice(['adults', 'older adults', 'teenagers'])}?"
        rows.append((f"i{k}", rnd.choice(["development", "development", "validation", "other"]), q))
        if k % 3 == 0:
            side = "test" if rows[-1][1] == "development" else "development"
            other = rnd.choice([q.upper(), q.replace("change", "alter"), "I would like to know: " + q, q.replace("Does", "Dooes"), q.replace("Does", "In short, does"), q.replace("tea", "juice")])
            rows.append((f"j{k}", side, other))
    want, got = brute(rows), pairs(overlap.p3_found(items(spark, rows)))
    assert got <= want and len(want - got) <= len(want) // 20 and len(want) > 15
    by = {i: q.lower() for i, _, q in rows}
    assert not any(("juice" in by[a]) != ("juice" in by[b]) for a, b in got)
    assert all(any(w in by[a] + by[b] for a, b in got) for w in ("alter", "know", "dooes"))


def test_edges(spark):
    rows = [("a", "development", "Is it so?"), ("a", "development", "Is it so?"), ("b", "test", "is it so"), ("c", "test", None), ("d", "development", ""), ("e", "test", "?!"), (None, "test", "Is it so?"), ("f", None, "Is it so?")]
    assert pairs(overlap.p3_found(items(spark, rows))) == {("a", "b")}
    assert overlap.p3_found(items(spark, rows).filter("false")).count() == 0
    long = "word " * 3000 + "end"
    assert pairs(overlap.p3_found(items(spark, [("a", "development", long), ("b", "test", long + " today")]))) == {("a", "b")}


def test_long_texts_of_different_words_have_few_keys(spark):
    rnd = random.Random(6)
    text = lambda n: " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(n))
    rows = [(f"{s}{n}", s, q) for n in (20, 60, 2500) for q in [text(n)] for s in ("development", "test")]
    rows = [(i, s, q + " today" if s == "test" else q) for i, s, q in rows]
    assert pairs(overlap.p3_found(items(spark, rows))) == {("development20", "test20"), ("development60", "test60"), ("development2500", "test2500")}


def test_report_counts_held_out_items(spark):
    rows = [("a", "development", "Is kelp tea good?"), ("b", "test", "is kelp tea good"), ("c", "test", "Is soy gel bad?")]
    r = overlap.overlap_report(items(spark, rows)).collect()
    assert [(x["items"], x["overlapping"]) for x in r] == [(2, 1)]


def test_rare_pairs_equal_brute_force(spark):
    from corpusloom.llm import blocking

    rnd = random.Random(4)
    rows = sorted({(r, left, t) for left in (True, False) for r in range(120) for t in [rnd.choice([*range(6)] * 6 + [*range(6, 40)]) for _ in range(rnd.randrange(1, 7))]})
    df = spark.createDataFrame(rows, "rec long, left boolean, token long").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        got = {tuple(r) for r in blocking.rare_pairs(df, 20, 4).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    n = Counter((left, t) for _, left, t in rows)
    often = {t: n[True, t] * n[False, t] for _, _, t in rows}
    want, keys = set(), {}
    for r, left in {x[:2] for x in rows}:
        own = [t for x, y, t in rows if (x, y) == (r, left) and often[t]]
        for t in own:
            if often[t] <= 20:
                keys.setdefault(t, []).append((r, left, False))
    frequent = {(r, left): [x for x in {t for a, b, t in rows if (a, b) == (r, left)} if often[x] > 20] for r, left, _ in rows}
    shared = {(a, b) for (a, x), d in frequent.items() if x for (b, y), e in frequent.items() if not y and len(set(d) & set(e)) == len(d) == len(e) and d}
    for members in keys.values():
        want |= {(a, b) for a, x, _ in members if x for b, y, _ in members if not y}
    assert want <= got and shared <= got and got
    assert all(set(frequent[a, True]) & set(frequent[b, False]) or (a, b) in want for a, b in got)


def test_pairs_that_share_only_frequent_digests_are_found(spark):
    rnd = random.Random(8)
    some = ["roasted barley tea", "kelp gel", "fall risk in adults", "bone density", "night shift nurses", "does change", "school children", "what is known about"]
    texts = sorted({" ".join(rnd.sample(some, 4)) for _ in range(900)})
    rows = [(k, rnd.choice(["development", "held"]), t) for k, t in enumerate(texts)]
    got = {(r["rec_a"], r["rec_b"]): (r["shared"], r["fraction_a"], r["fraction_b"]) for r in overlap.chunk_pairs(spark.createDataFrame(rows, "rec long, split string, norm string"), "development", ["held"], 0.6).collect()}
    cuts = {k: {c: len(c) for c in overlap.cut_points(t)} for k, _, t in rows}
    want = {}
    for a, s, _ in rows:
        for b, t, _ in rows:
            if s == "development" and t == "held" and (n := sum(cuts[a][c] for c in cuts[a].keys() & cuts[b].keys())):
                x, y = n / sum(cuts[a].values()), n / sum(cuts[b].values())
                if max(x, y) >= 0.6:
                    want[a, b] = (n, x, y)
    assert got == want and len(want) > 1000


def test_overlapping_equals_brute_force(spark, monkeypatch):
    from corpusloom.llm import blocking

    monkeypatch.setattr(blocking, "BLOCK", 100)  # several cells a token
    rnd = random.Random(5)
    size = lambda k: 90 if k % 100 == 7 else rnd.randrange(1, 12)
    sets = {(k, left): {int(700 * rnd.random() ** 3) for _ in range(size(k))} for left in (True, False) for k in range(500)}
    weight = {t: 1 + t % 3 for t in range(700)}
    total = {x: sum(weight[t] for t in d) + (x[0] % 2) for x, d in sets.items()}
    share = {x: rnd.choice([0.5, 0.6]) for x in sets}
    rows = [(k, left, t, weight[t], total[k, left], share[k, left]) for (k, left), d in sets.items() for t in d]
    df = spark.createDataFrame(rows, "rec long, left boolean, token long, weight int, total long, share double").repartition(5)
    got = [tuple(r) for r in blocking.overlapping(df, 0.5).collect()]
    want = set()
    for (a, x), d in sets.items():
        for (b, y), e in sets.items():
            if x and not y and (n := sum(weight[t] for t in d & e)) and n >= share[b, y] * min(total[a, x], total[b, y]) - 1e-9:
                want.add((a, b, n, total[a, x], total[b, y]))
    assert len(got) == len(set(got)) and set(got) == want and any(len(sets[a, True]) > 64 for a, *_ in want)
