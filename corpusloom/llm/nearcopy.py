"""Near-same texts by a chosen-path join over word shingles.

A text is its set of three-word runs; copies with equal sets are one class. A path
is a combination of shingles of a set, chosen by shared random hashes, so two
similar sets choose many of the same paths. Every set samples about PATHS of its
shingles: as many independent runs, each of one shingle, as bring the chance that a
pair of similarity LEAST shares none under 1 - RECALL. The classes are grouped by
these paths. A bucket of at most SMALL classes is compared pair by pair. A larger
one in which a share DENSE of the pairs looks similar is compared as a whole, in
blocks: that is no more than a few times the pairs it yields. Any other is split:
every class in it extends the path by its other sampled shingles with large
buckets, at most DEEPER children a class, chosen by hash. What is still together
after LEVELS shingles is compared in blocks too, so no bucket is dropped.

Comparisons inside a bucket use a packed min-hash sketch that travels with the
path; survivors are verified on their whole texts. Hot shingles are stopped at the
mapper: a task sends at most SMALL + 1 rows of one path, enough to show that the
bucket is large; its members are found again from the table of classes, which is
made once and holds sketch and sampled shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shingles import agreeing, mix, set_hashes, shingle_sets, sketches
from corpusloom.sources.tables import broadcast_if_small, cut, stored

#: Target recall of a pair at the least similarity, and the runs (sampled shingles) that give it.
RECALL, LEAST = 0.9997, 0.7
PATHS = math.ceil(-math.log(1 - RECALL) / LEAST)
#: Classes of a bucket compared pair by pair; children of a class at each further level; shingles of the longest path.
SMALL, DEEPER, LEVELS = 192, 12, 4
#: Share of similar pairs among SMALL + 1 members from which a large bucket is not split.
DENSE = 0.3
#: Agreeing bins of 32 that a candidate needs: similarity 0.7 falls short once in 5,000 times.
AGREE = 14
#: Texts worked on at once.
STEP = 1500


def _parts(batches: Iterator[pa.RecordBatch], step: int = STEP):
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def _sampled(value: np.ndarray, offsets: np.ndarray, paths: int) -> np.ndarray:
    """Which shingles their sets choose: about `paths` of each, the same in similar sets."""
    n = np.maximum(np.diff(offsets), 1)
    most = np.minimum(1.0, paths / n) * float(1 << 53)
    draw = (mix(value + np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(11)).astype(np.float64)
    return draw < np.repeat(most, np.diff(offsets))


def _facts(size: int, paths: int):
    """Of each row its class; of each class new to the task also its sketch and sampled shingles."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in _parts(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            value, offsets = shingle_sets(texts, size)
            own = set_hashes(value, offsets, texts)
            fresh = np.fromiter((c not in done and not done.add(c) for c in own.tolist()), bool, len(own)) & (np.diff(offsets) > 0)
            sketch = sketches(value, offsets)
            doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
            take = _sampled(value, offsets, paths) & fresh[doc]
            count = np.bincount(doc[take], minlength=len(texts))
            ends = np.r_[0, np.cumsum(count)].astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(value[take].astype(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x) for x in (own, sketch[:, 0], sketch[:, 1], fresh)), tokens], names=["row_id", "cls", "s1", "s2", "fresh", "tokens"]
            )

    return work


def _pairs(cls: np.ndarray, sketch: np.ndarray, agree: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.triu_indices(len(cls), 1)
    same = agreeing(sketch[a], sketch[b]) >= agree
    x, y = cls[a[same]], cls[b[same]]
    return np.minimum(x, y), np.maximum(x, y)


def _buckets(small: int, agree: int):
    """Rows sorted by path: candidate pairs (a, b, null) of small buckets, and (null, 1 if dense else 0, path) of each large one."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        large: list[int] = []  # the last is the path still coming

        def work(rows: list[np.ndarray], last: bool):
            """Candidates and large paths of the complete runs in `rows`; the open run if it is not yet large."""
            path = rows[0]
            starts = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])
            ends = np.r_[starts[1:], len(path)]
            pairs_a, pairs_b, found, dense, left = [], [], [], [], None
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                if large and path[s] == large[-1]:
                    continue
                if e - s > small:
                    large.append(int(path[s]))
                    found.append(int(path[s]))
                    some = slice(s, s + small + 1)
                    like = len(_pairs(rows[1][some], np.stack([rows[2][some], rows[3][some]], 1), agree)[0])
                    dense.append(int(like >= DENSE * small * (small + 1) / 2))
                elif e == len(path) and not last:
                    left = [r[s:] for r in rows]
                elif e - s > 1:
                    a, b = _pairs(rows[1][s:e], np.stack([rows[2][s:e], rows[3][s:e]], 1), agree)
                    pairs_a.append(a)
                    pairs_b.append(b)
            del large[:-1]
            none = np.zeros(0, np.int64)
            a, b, p = np.concatenate([none, *pairs_a]), np.concatenate([none, *pairs_b]), np.array(found, np.int64)
            mask = np.r_[np.zeros(len(a), bool), np.ones(len(p), bool)]
            full = [pa.array(np.r_[a, np.zeros(len(p), np.int64)], mask=mask), pa.array(np.r_[b, np.array(dense, np.int64)])]
            return pa.RecordBatch.from_arrays([*full, pa.array(np.r_[np.zeros(len(a), np.int64), p], mask=~mask)], names=["a", "b", "path"]), left

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if carry is not None:
                rows = [np.concatenate([x, y]) for x, y in zip(carry, rows, strict=True)]
            result, carry = work(rows, False)
            yield result
        if carry is not None:
            yield work(carry, True)[0]

    return compare


_SPLIT = "a long, b long, path long"


def _ranks(group: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The place of each entry within its group when taken in `order` (which sorts by group)."""
    g = group[order]
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    rank = np.empty(len(g), np.int64)
    rank[order] = np.arange(len(g)) - np.repeat(starts, np.diff(np.r_[starts, len(g)]))
    return rank


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, lengths) of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def _grow(most: int | None, small: int | None):
    """(path, cls, s1, s2, at): each path of a class grown by each later token of it.

    With `most`, the so many children of a class of least hash; with `small`, of one
    path at most that many + 1 rows from one task.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[int, int] = {}
        for batch in _parts(batches, 8192):
            token, size = _flat(batch.column(3))
            key, held = _flat(batch.column(4))
            at, _ = _flat(batch.column(5))
            doc = np.repeat(np.arange(batch.num_rows), size)
            token = token[np.lexsort((token, doc))]
            begin = np.r_[0, np.cumsum(size)]
            owner = np.repeat(np.arange(batch.num_rows), held)
            count = size[owner] - 1 - at
            source = np.repeat(np.arange(len(key)), count)
            last = at[source] + 1 + np.arange(len(source)) - np.repeat(np.cumsum(count) - count, count)
            owner = owner[source]
            path = mix(token[begin[owner] + last].astype(np.uint64) + key[source].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            if most is not None:
                keep = _ranks(owner, np.lexsort((path, owner))) < most
                path, owner, last = path[keep], owner[keep], last[keep]
            path = path.astype(np.int64)
            if small is not None:
                each, inverse, n = np.unique(path, return_inverse=True, return_counts=True)
                before = np.fromiter((sent.get(p, 0) for p in each.tolist()), np.int64, len(each))
                sent.update(zip(each.tolist(), (before + n).tolist(), strict=True))
                keep = before[inverse] + _ranks(inverse, np.argsort(inverse, kind="stable")) <= small
                path, owner, last = path[keep], owner[keep], last[keep]
                if len(sent) > 2_000_000:  # a path forgotten is only sent more often
                    sent = {p: k for p, k in sent.items() if k > 1}
            rest = [batch.column(k).to_numpy(zero_copy_only=False)[owner] for k in range(3)]
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (path, *rest, last.astype(np.int64)))], names=["path", "cls", "s1", "s2", "at"])

    return work


_GROWN = "path long, cls long, s1 long, s2 long, at long"


def _blocks(rows: DataFrame, block: int, agree: int) -> DataFrame:
    """Candidate pairs of every bucket, however large: blocks of it against each other."""
    rows = rows.select("path", "cls", "s1", "s2")
    size = rows.groupBy("path").agg(F.count("*").alias("size")).filter("size > 1").select("path", F.ceil(F.col("size") / block).cast("int").alias("nb"))
    tagged = rows.join(size, "path").withColumn("own", F.expr("cast(pmod(xxhash64(cls), nb) as int)"))
    spread = tagged.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    spread = spread.select("path", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "cls", "s1", "s2")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def close():
            rows = np.array(held, np.int64).reshape(-1, 3)
            x, y = _pairs(rows[:, 0], rows[:, 1:], agree)
            return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

        for batch in batches:
            for p, i, j, *row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (p, i, j) != key:
                    if len(held) > 1:
                        yield close()
                    key, held = (p, i, j), []
                held.append(row)
        if len(held) > 1:
            yield close()

    return spread.repartition("path", "i", "j").sortWithinPartitions("path", "i", "j").mapInArrow(compare, "a long, b long").filter("a <> b")


def classes_of(facts: DataFrame) -> DataFrame:
    """cls, s1, s2, tokens: one row a class, of `facts` as `_facts` makes them."""
    return facts.filter("fresh").groupBy("cls").agg(*(F.first(c).alias(c) for c in ("s1", "s2", "tokens")))


def candidates(classes: DataFrame, small: int = SMALL, agree: int = AGREE, deeper: int = DEEPER, levels: int = LEVELS) -> DataFrame:
    """Candidate class pairs (a < b) of the chosen-path join over `classes` (stored: cls, s1, s2, tokens)."""
    frontier = classes.select("cls", "s1", "s2", "tokens", F.array(F.lit(0).cast("long")).alias("keys"), F.array(F.lit(-1).cast("long")).alias("at"))
    found = []
    for level in range(1, levels + 1):
        most = None if level == 1 else deeper
        rows = frontier.mapInArrow(_grow(most, small), _GROWN).select("path", "cls", "s1", "s2")
        split = cut(rows.repartition("path").sortWithinPartitions("path").mapInArrow(_buckets(small, agree), _SPLIT))
        found.append(split.filter("path is null").select("a", "b"))
        large = split.filter("path is not null").select("path", (F.col("b") == 1).alias("dense")).distinct()
        if large.isEmpty():
            break
        on = frontier.mapInArrow(_grow(most, None), _GROWN).join(broadcast_if_small(large), "path")
        found.append(_blocks(on if level == levels else on.filter("dense"), small, agree))
        if level == levels:
            break
        going = on.filter("not dense").groupBy("cls").agg(F.collect_list(F.struct("at", "path")).alias("g"))
        joined = frontier.select("cls", "s1", "s2", "tokens").join(going, "cls")
        if level == 1:  # a shingle whose bucket is small has shown all its pairs
            large_tokens = F.expr("transform(g, x -> array_sort(tokens)[int(x.at)])")
            frontier = joined.select("cls", "s1", "s2", F.array_sort(large_tokens).alias("tokens"), F.expr("transform(array_sort(g), x -> x.path)").alias("keys"), F.expr("transform(sequence(0, size(g) - 1), i -> bigint(i))").alias("at"))
        else:
            frontier = joined.select("cls", "s1", "s2", "tokens", F.expr("transform(g, x -> x.path)").alias("keys"), F.expr("transform(g, x -> x.at)").alias("at"))
        frontier = stored(frontier)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def shingle_table(rows: DataFrame, members: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """cls, shingles of the classes in `ids`: only one row of each is read again and cut into shingles."""
    wanted = broadcast_if_small(ids)
    first = cut(members.join(wanted, "cls", "left_semi").groupBy("cls").agg(F.min("row_id").alias("row_id")))
    texts = rows.join(broadcast_if_small(first.select("row_id").distinct()), "row_id", "left_semi").select("text")
    return texts.mapInArrow(_sets(size), "cls long, shingles array<long>").join(wanted, "cls", "left_semi").groupBy("cls").agg(F.first("shingles").alias("shingles"))


def _sets(size: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            texts = [t or "" for t in batch.column(0).to_pylist()]
            value, offsets = shingle_sets(texts, size)
            sets = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(value.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(set_hashes(value, offsets, texts)), sets], names=["cls", "shingles"])

    return work


def _verify(least: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both / max(1, len(a) + len(b) - both))
            kept = pa.array(keep, pa.float64())
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), kept], names=["a", "b", "similarity"])
            yield out.filter(pa.array(np.array(keep) >= least))

    return work


def verified(pairs: DataFrame, rows: DataFrame, members: DataFrame, least: float, size: int) -> DataFrame:
    """Of the candidate pairs (a, b) those whose whole shingle sets have similarity `least`, with it."""
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct())
    sets = shingle_table(rows, members, ids, size)
    joined = pairs.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("y")), "b")
    return cut(joined.select("a", "b", "x", "y").mapInArrow(_verify(least), "a long, b long, similarity double"))


def similar_classes(rows: DataFrame, least: float = LEAST, size: int = 3, paths: int = PATHS, **options) -> tuple[DataFrame, DataFrame]:
    """(links, members): verified class pairs (a < b, similarity) and every row's class.

    `rows`: row_id long, text string; rows without either have no class. Both
    results are cut; equal sets of shingles are one class and no link. similarity is
    over whole texts.
    """
    rows = rows.select(F.col("row_id").cast("long").alias("row_id"), F.col("text").cast("string").alias("text")).filter("text is not null and row_id is not null")
    facts = stored(rows.mapInArrow(_facts(size, paths), "row_id long, cls long, s1 long, s2 long, fresh boolean, tokens array<long>"))
    members = facts.select("row_id", "cls")
    pairs = cut(candidates(stored(classes_of(facts)), **options))
    return verified(pairs, rows, members, least, size), members


def near_same_pairs(rows: DataFrame, least: float = LEAST, size: int = 3, block: int = 4096, **options) -> DataFrame:
    """row_id_a < row_id_b of every two rows whose shingle sets have similarity `least` or more.

    Equal texts are pairs too. Null texts and null ids have none; texts without a
    word pair only with the very same text; a text of fewer than `size` words is
    one shingle; rows with one row_id count once. Extra columns are not read.
    """
    links, members = similar_classes(rows, least, size, **options)
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    members = members.distinct()
    often = members.groupBy("cls").agg(F.count("*").alias("n"))
    sides = often.filter("n > 1").select(F.col("cls").alias("a"), F.col("cls").alias("b")).unionByName(both)
    # copies of a class are spread over blocks, and each block of one side meets each of the other
    blocks = often.select("cls", F.ceil(F.col("n") / block).cast("int").alias("nb"))
    spread = members.join(blocks, "cls").select("cls", F.expr("cast(pmod(xxhash64(row_id), nb) as int)").alias("k"), "row_id")
    numbered = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
    for side in ("a", "b"):
        sides = sides.join(blocks.withColumnRenamed("cls", side), side).withColumn(f"k_{side}", numbered).drop("nb")
    right = spread.select(F.col("cls").alias("b"), F.col("k").alias("k_b"), F.col("row_id").alias("row_id_b"))
    left = spread.select(F.col("cls").alias("a"), F.col("k").alias("k_a"), F.col("row_id").alias("row_id_a"))
    return sides.join(right, ["b", "k_b"]).join(left, ["a", "k_a"]).filter("row_id_a < row_id_b").select("row_id_a", "row_id_b")


def components(links: DataFrame, members: DataFrame) -> DataFrame:
    """row_id, group_id, links: each row's group (the least class number reachable) and its class's links.

    Each round a class takes the least label among its neighbours and then the label
    of the class it is named after, so labels travel ever longer steps; rounds go on,
    each written to the checkpoint folder, until no label moves.
    """
    edges = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = cut(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")))
    while True:
        spread = edges.join(label.select(F.col("a").alias("b"), F.col("label").alias("other")), "b").groupBy("a").agg(F.min("other").alias("other"))
        near = cut(label.join(spread, "a").select("a", "label", F.least("label", "other").alias("next")))
        jumped = near.select("a", "label", "next").join(near.select(F.col("a").alias("next"), F.col("next").alias("far")), "next")
        after = cut(jumped.select("a", F.col("far").alias("label"), (F.col("far") < F.col("label")).alias("moved")))
        label = after.select("a", "label")
        if after.filter("moved").isEmpty():
            break
    degree = edges.groupBy("a").agg(F.count("*").alias("links"))
    named = label.join(degree, "a").withColumnRenamed("a", "cls")
    return members.join(named, "cls", "left").select("row_id", F.coalesce("label", "cls").alias("group_id"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))


def p4_found(chunks: DataFrame) -> DataFrame:
    """row_id_a, row_id_b of pool chunks with near-same text."""
    return near_same_pairs(chunks.select("row_id", "text"))


def near_same_groups(chunks: DataFrame) -> DataFrame:
    """One row per chunk: its group of near-same texts and its class's number of links."""
    links, members = similar_classes(chunks.select("row_id", "text"))
    return components(links, members)
