import random
import re

import numpy as np

from corpusloom.llm import nearcopy, shingles


def brute(rows, least=0.7):
    sets = []
    for i, t in rows:
        if t is None or i is None:
            continue
        w = re.findall(r"[^\W_]+", t.lower())
        sets.append((i, frozenset(zip(w, w[1:], w[2:], strict=False)) or (("few", *w) if w else ("none", t))))
    out = set()
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i == j:
                continue
            same = a == b
            if isinstance(a, frozenset) and isinstance(b, frozenset) and not same:
                same = len(a & b) >= least * len(a | b)
            if same:
                out.add((min(i, j), max(i, j)))
    return out


def corpus(n=220, seed=2):
    rnd = random.Random(seed)
    common = [[rnd.choice("abcdefghij") + str(rnd.randrange(30)) for _ in range(12)] for _ in range(6)]
    rows = []
    for k in range(n):
        words = sum(rnd.sample(common, 2), []) + [f"w{rnd.randrange(4000)}" for _ in range(40)]
        rows.append((k, " ".join(words)))
        if k % 4 == 0:
            edited = list(words)
            for _ in range(rnd.randrange(4)):
                edited[rnd.randrange(len(edited))] = f"x{rnd.randrange(9999)}"
            rows.append((10_000 + k, " ".join(edited)))
    return rows


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "row_id long, text string, cls int").repartition(3)
    return {tuple(r) for r in nearcopy.near_same_pairs(df, **options).collect()}


def test_shingle_sets_equal_a_plain_version():
    texts = ["One two, three four!", "", "a b", "ÄRGER über Öl 3", "x x x x", "日本 語 テ"]
    value, offsets = shingles.shingle_sets(texts)
    assert np.diff(offsets).tolist() == [2, 0, 1, 2, 1, 1]
    again, _ = shingles.shingle_sets(["three four", "ONE TWO THREE"])
    assert again[1] in value[:2]
    own = shingles.set_hashes(value, offsets, texts)
    assert len(set(own.tolist())) == len(texts)


def test_sketch_agreement_follows_similarity():
    a = shingles.mix(np.arange(200, dtype=np.uint64))
    b = np.sort(np.r_[a[:180], shingles.mix(np.arange(900, 920, dtype=np.uint64))])
    s = shingles.sketches(np.r_[np.sort(a), b], np.array([0, 200, 400]))
    assert shingles.agreeing(s[:1], s[1:])[0] >= 18
    assert shingles.agreeing(s[:1], s[:1])[0] == 32


def test_equals_brute_force(spark):
    rows = corpus()
    got, want = found(spark, rows), brute(rows)
    assert got <= want and len(want - got) <= max(1, len(want) // 50)


def test_large_buckets_are_split_and_none_dropped(spark):
    rows = corpus(120, 7)
    want = brute(rows)
    # every bucket of three or more is large, so all pairs come from deeper paths and blocks
    got = found(spark, rows, small=2, paths=12)
    assert got <= want and len(want - got) <= max(1, len(want) // 20)


def test_hot_group_of_near_copies_is_whole(spark):
    base = [f"h{k}" for k in range(60)]
    rows = [(k, " ".join(base + [f"t{k}"])) for k in range(40)] + [(100 + k, " ".join(base)) for k in range(10)]
    assert found(spark, rows, small=8) == brute(rows)


def test_large_group_of_edited_texts_is_whole(spark):
    # each text's own edits fill small buckets, which must not keep it from the rest of its group
    for n, length in ((1100, 70), (600, 60)):
        rnd = random.Random(5)
        rows = []
        for k in range(n):
            words = [f"h{j}" for j in range(length)]
            for _ in range(rnd.randrange(1, 5)):
                words[rnd.randrange(length)] = f"x{rnd.randrange(10**6)}"
            rows.append((k, " ".join(words)))
        got, want = found(spark, rows), brute(rows)
        assert got <= want and len(want - got) <= len(want) // 200


def test_edges(spark):
    rows = [(1, "same few"), (2, "Same, few."), (3, "other few"), (4, ""), (5, ""), (6, "!?"), (7, None), (None, "same few"), (8, "…"), (9, "…")]
    assert found(spark, rows) == {(1, 2), (4, 5), (8, 9)}
    assert found(spark, [(1, "a b c d")]) == set()
    long = " ".join(f"w{k}" for k in range(60_000))
    assert found(spark, [(1, long), (2, long + " more")]) == {(1, 2)}


def test_groups_are_components(spark):
    base = [f"h{k}" for k in range(40)]
    rows = [(1, " ".join(base)), (2, " ".join(base[3:] + ["a", "b", "c"])), (3, " ".join(base[6:] + ["a", "b", "c", "d", "e", "f"])), (4, "quite another text with words"), (5, "quite another text with words")]
    df = spark.createDataFrame(rows, "row_id long, text string")
    g = {r["row_id"]: (r["group_id"], r["links"]) for r in nearcopy.near_same_groups(df).collect()}
    assert g[1][0] == g[2][0] == g[3][0] != g[4][0] == g[5][0]
    assert g[2][1] == 2 and g[4][1] == 0


def test_a_long_chain_is_one_group(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(120)], "a long, b long")
    members = spark.createDataFrame([(k, k) for k in range(122)], "row_id long, cls long")
    g = {r["row_id"]: r["group_id"] for r in nearcopy.components(links, members).collect()}
    assert {g[k] for k in range(121)} == {0} and g[121] == 121


def test_a_run_in_every_text_neither_floods_a_task_nor_hides_pairs(spark):
    boiler = "terms of use apply to all of this"
    rnd = random.Random(8)
    rows = [(k, f"{boiler} " + " ".join(f"w{rnd.randrange(10**6)}" for _ in range(14))) for k in range(700)]
    rows += [(1000 + k, rows[k][1].rsplit(" ", 1)[0] + " other") for k in range(40)]
    assert found(spark, rows, small=20) == brute(rows)


def test_copies_beyond_a_block_pair_with_both_sides_cut(spark):
    base = [f"h{k}" for k in range(40)]
    rows = [(k, " ".join(base)) for k in range(25)] + [(100 + k, " ".join([*base, "end"])) for k in range(13)]
    assert found(spark, rows, block=4) == brute(rows)
