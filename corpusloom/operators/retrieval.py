"""Ranking and selecting passages: exact vector top-k, diversity, caps, labels, allocations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Queries and items of one comparison; up to one block of queries is broadcast.
QUERY_BLOCK, ITEM_BLOCK = 1024, 4096
_FOUND = "query_id long, item_id long, similarity double"


def top_k_similar(queries: DataFrame, items: DataFrame, k: int, query_block: int = QUERY_BLOCK, item_block: int = ITEM_BLOCK) -> DataFrame:
    """query_id, item_id, similarity, place: the k nearest items of each query by cosine, ties by id.

    `queries`: query_id, vector; `items`: item_id, vector. Queries that fit one
    block (counted first) are broadcast and every task compares its items with all
    of them in one matrix product. More are cut into blocks, as the items are, and
    each pair of blocks is one comparison. Either way k rows of a query and
    comparison are shuffled, not the pairs. Null vectors match nothing; vectors of
    different widths are an error.
    """
    queries = queries.select(F.col("query_id").cast("long").alias("query_id"), "vector").filter("vector is not null")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "vector").filter("vector is not null")
    widths = [r["w"] for r in queries.select(F.size("vector").alias("w")).union(items.select(F.size("vector").alias("w"))).distinct().limit(2).collect()]
    if len(widths) > 1:
        raise ValueError(f"vectors of different widths: {sorted(widths)}")
    n = queries.count()
    if n <= query_block:
        rows = queries.collect()
        shared = queries.sparkSession.sparkContext.broadcast([(r["query_id"], r["vector"]) for r in rows])
        found = items.mapInArrow(_nearest(shared, k), _FOUND)
    else:
        nq, ni = -(-n // query_block), max(1, -(-items.count() // item_block))
        q = queries.groupBy(F.expr(f"cast(pmod(xxhash64(query_id), {nq}) as int)").alias("qb")).agg(F.collect_list(F.struct("query_id", "vector")).alias("q"))
        i = items.groupBy(F.expr(f"cast(pmod(xxhash64(item_id), {ni}) as int)").alias("ib")).agg(F.collect_list(F.struct("item_id", "vector")).alias("i"))
        pairs = q.withColumn("ib", F.explode(F.sequence(F.lit(0), F.lit(ni - 1)))).join(i, "ib").select("q", "i")
        found = pairs.mapInArrow(_nearest_of_blocks(k), _FOUND)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "item_id"))
    return found.withColumn("place", place).filter(F.col("place") <= k)


def _best(queries: list[tuple[int, list[float]]], items: list[tuple[int, list[float]]], k: int) -> list[tuple[int, int, float]]:
    if not queries or not items:
        return []
    q, m = np.array([v for _, v in queries], np.float64), np.array([v for _, v in items], np.float64)
    score = (q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)) @ (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)).T
    names = np.array([i for i, _ in items])
    out = []
    for row, (query, _) in enumerate(queries):
        out += [(query, int(names[o]), float(score[row, o])) for o in np.lexsort((names, -score[row]))[:k]]
    return out


def _rows(found: list[tuple[int, int, float]]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) or [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["query_id", "item_id", "similarity"])


def _nearest(shared, k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[float, int]]] = {}
        for batch in batches:
            items = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            for query, item, score in _best(shared.value, items, k):
                best.setdefault(query, []).append((-score, item))
            best = {q: sorted(b)[:k] for q, b in best.items()}
        yield _rows([(q, i, -s) for q, b in best.items() for s, i in b])

    return work


def _nearest_of_blocks(k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield _rows(_best([(x["query_id"], x["vector"]) for x in q], [(x["item_id"], x["vector"]) for x in i], k))

    return work


def mmr(query: list[float], vectors: list[list[float]], k: int, weight: float = 0.7, window: int | None = None, normalise: bool = True) -> list[int]:
    """Positions chosen by maximal marginal relevance: weight * relevance - (1 - weight) * nearest chosen; the first of equals.

    `window`: only that many of the most relevant are considered. Without
    `normalise` the raw dot product stands for similarity.
    """
    if not vectors or k < 1:
        return []
    m, q = np.array(vectors, np.float64), np.array(query, np.float64)
    if normalise:
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        m = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
        q = q / np.linalg.norm(q) if np.linalg.norm(q) else q
    relevance = m @ q
    left = list(range(len(m))) if window is None else sorted(np.argsort(-relevance, kind="stable")[: min(max(window, k), len(m))].tolist(), key=lambda i: (-relevance[i], i))
    nearest, chosen = np.full(len(m), -np.inf), []
    while left and len(chosen) < k:
        score = [weight * relevance[i] - (1 - weight) * (nearest[i] if chosen else 0.0) for i in left]
        at = left.pop(int(np.argmax(score)))
        chosen.append(at)
        nearest = np.maximum(nearest, m @ m[at])
    return chosen


def mmr_per_query(candidates: DataFrame, k: int, weight: float = 0.7, window: int = 60) -> DataFrame:
    """query_id, item_id, place chosen by MMR among each query's `window` most relevant candidates.

    `candidates`: query_id, item_id, query_vector, vector, similarity. The window is
    cut before the grouped step, so a group in memory has at most `window` rows.
    """
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "item_id"))
    cut = candidates.withColumn("_rank", rank).filter(F.col("_rank") <= window)

    def choose(pdf):  # noqa: ANN001, ANN202
        pdf = pdf.sort_values("_rank")
        chosen = mmr(list(pdf["query_vector"].iloc[0]), [list(v) for v in pdf["vector"]], k, weight)
        out = pdf.iloc[chosen][["query_id", "item_id"]].copy()
        out["place"] = range(1, len(out) + 1)
        return out

    return cut.groupBy("query_id").applyInPandas(choose, "query_id long, item_id long, place int")


def capped_per_source(df: DataFrame, group: str, source: str, order: list[Column], cap: int, k: int) -> DataFrame:
    """The first k of each group with at most `cap` of a source, then the rest in order; `place` from 1."""
    within = F.row_number().over(Window.partitionBy(group, source).orderBy(*order))
    ranked = df.withColumn("_within", within)
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.col("_within") > cap, *order))
    return ranked.withColumn("place", place).filter(F.col("place") <= k).drop("_within")


def first_use_labels(df: DataFrame, group: str, item: str, order: str, prefix: str = "S") -> DataFrame:
    """Labels S1, S2, ... by first use of an item within the group; repeated use keeps the label."""
    first = df.groupBy(group, item).agg(F.min(order).alias("first_use"), F.count("*").alias("uses"))
    rank = F.dense_rank().over(Window.partitionBy(group).orderBy("first_use", item))
    return first.withColumn("label", F.concat(F.lit(prefix), rank.cast("string")))


def allocated(df: DataFrame, group: str, core: str, position: str, total: int) -> DataFrame:
    """`passages` of each row: an even split of `total`, the remainder to core rows first, then in order."""
    n = F.count("*").over(Window.partitionBy(group))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(core), position))
    return df.withColumn("passages", (F.floor(F.lit(total) / n) + (place <= F.lit(total) % n).cast("int")).cast("int"))


def greedy_leaders(vectors: list[list[float]], least: float, most: int) -> list[int]:
    """Positions kept one after the other while their cosine to every kept one stays below `least`."""
    kept: list[int] = []
    m = np.array(vectors, np.float64)
    if not len(m):
        return kept
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    m = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
    for i in range(len(m)):
        if len(kept) >= most:
            break
        if not kept or float(np.max(m[kept] @ m[i])) < least:
            kept.append(i)
    return kept


def pairs_above(df: DataFrame, group: str, key: str, vector: str, least: float, block: int = ITEM_BLOCK) -> DataFrame:
    """group, a < b, similarity: pairs of a group whose cosine is `least` or more.

    A group is cut into blocks of about `block` vectors by a hash of the key, and each
    block meets each other once; only pairs that pass leave a comparison, and no
    group is ever in one task. Null groups, keys and vectors have no pair.
    """
    rows = df.select(F.col(group).alias("g"), F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v")).filter("g is not null and k is not null and v is not null")
    size = rows.groupBy("g").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    own = rows.join(size, "g").withColumn("own", F.expr("cast(pmod(xxhash64(k), n) as int)")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    cells = own.select("g", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "k", "v")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []

        def close() -> pa.RecordBatch:
            side, keys = np.array([h[0] for h in held]), np.array([h[1] for h in held], np.int64)
            m = np.array([h[2] for h in held], np.float64)
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            m = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
            score = m @ m.T
            keep = (score >= least) & (keys[:, None] < keys[None, :])
            if cell[1] != cell[2]:
                keep &= side[:, None] != side[None, :]
            x, y = np.nonzero(keep)
            return pa.RecordBatch.from_arrays([pa.array([cell[0]] * len(x), kind), pa.array(keys[x]), pa.array(keys[y]), pa.array(score[x, y])], names=["g", "a", "b", "similarity"])

        for batch in batches:
            kind = batch.schema.field("g").type
            for g, i, j, own_, k, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (g, i, j) != cell:
                    if held:
                        yield close()
                    cell, held = (g, i, j), []
                held.append((own_, k, v))
        if held:
            yield close()

    kind = dict(rows.dtypes)["g"]
    return cells.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j").mapInArrow(compare, f"g {kind}, a long, b long, similarity double")
