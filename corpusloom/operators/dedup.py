"""First-wins and merging deduplication, upserts and latest records."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by `order`, with `copies`, the rows it stands for.

    The minimum travels through partial aggregation, so a hot key shrinks before
    the shuffle. Rows with a null in a key stay as they are: unknown is no match.
    """
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    row = F.struct(*[F.col(c) for c in df.columns])
    least = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    best = df.filter(known).groupBy(*keys).agg(F.min_by(row, least).alias("r"), F.count("*").alias("copies")).select("r.*", "copies")
    return best.unionByName(df.filter(~known).withColumn("copies", F.lit(1).cast("long")))


def upsert(stored: DataFrame, batch: DataFrame, key: str, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(rows to append, counts): new, present and duplicate rows of `batch` by `key`; they add up to requested."""
    present = stored.select(key).distinct().withColumn("_there", F.lit(True))
    tagged = first_wins(batch, [key], order).join(present, key, "left")
    counts = tagged.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("requested"), F.count_if(F.col("_there").isNull()).alias("new"), F.count_if(F.col("_there").isNotNull()).alias("present"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate"),
    )
    return tagged.filter(F.col("_there").isNull()).drop("_there", "copies"), counts


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by `order`."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*keys).agg(F.max_by(row, F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("r")).select("r.*")


def ordered_fold(df: DataFrame, group: str, order: list[str], step: Callable[[object, dict], tuple[object, tuple | None]], start: Callable[[], object], schema: str) -> DataFrame:
    """A sequential fold over each group's rows in order, streaming: `step(state, row)` gives the next state and a row to emit or None.

    For semantics in which each row depends on what was kept before it. Groups are
    co-located and sorted by the shuffle and pass through one at a time; only the
    state is held, never a group.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, any_yet = None, None, False
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if not any_yet or row[group] != current:
                    current, state, any_yet = row[group], start(), True
                state, out = step(state, row)
                if out is not None:
                    rows.append(dict(zip(names, out, strict=True)))
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)
    return df.repartition(group).sortWithinPartitions(group, *order).mapInArrow(work, schema)


def kept_unless_seen(df: DataFrame, group: str, order: list[str], keys: list[str]) -> DataFrame:
    """Rows none of whose `keys` a row kept before them in the group has: dropped rows block nothing."""

    def step(seen: set, row: dict):
        own = {(k, row[k]) for k in keys if row[k] is not None}
        if own & seen:
            return seen, None
        seen |= own
        return seen, tuple(row[c] for c in row)

    schema = ", ".join(f"{n} {t}" for n, t in df.dtypes)
    return ordered_fold(df, group, order, step, set, schema)


def merged_candidates(df: DataFrame, group: str, order: list[str], key: str, keys: str, size: str) -> DataFrame:
    """`group`, `key`, `owner`: each candidate with the kept one it merges into, in order.

    A candidate that shares any of its `keys` with kept ones joins the earliest of
    them; a bridge does not merge two groups that exist. The longer text stands for
    a group when exactly one matched (column `stands`). Not transitive, so order is
    part of the meaning.
    """

    def step(state: dict, row: dict):
        mine = row[keys] or []
        hit = sorted({state["owner"][k] for k in mine if k in state["owner"]})
        if not hit:
            at = len(state["text"])
            state["text"].append(row[size] or 0)
            stands = True
        else:
            at = hit[0]
            stands = len(hit) == 1 and (row[size] or 0) > state["text"][at]
            if stands:
                state["text"][at] = row[size] or 0
        for k in mine:
            state["owner"][k] = at
        return state, (row[group], row[key], at, stands)

    schema = f"{group} {dict(df.dtypes)[group]}, {key} {dict(df.dtypes)[key]}, owner int, stands boolean"
    return ordered_fold(df.select(group, key, keys, size, *[o for o in order if o not in (group, key, keys, size)]), group, order, step, lambda: {"owner": {}, "text": []}, schema)


def found_by(df: DataFrame, key: str, finder: str, order: str) -> DataFrame:
    """key, finders: who found it, distinct, in order of first appearance."""
    first = df.groupBy(key, finder).agg(F.min(order).alias("_first"))
    listed = F.array_sort(F.collect_list(F.struct("_first", finder)))
    return first.groupBy(key).agg(F.transform(listed, lambda x: x[finder]).alias("finders"))


def numbered(df: DataFrame, group: str, order: list[Column], name: str = "position") -> DataFrame:
    """0-based position within the group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1)
