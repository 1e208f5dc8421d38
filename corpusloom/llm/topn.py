"""Top N items of every group by a multiway merge of sorted runs.

Three steps. (1) Each input partition is cut into runs sorted by group and
order; a run keeps N rows of a group, which is all a merge can ever need of it,
so a hot group shrinks before any shuffle. (2) Runs are stored by bucket of
(group, salt): the shuffle sorts them by group, run and order, and a loser tree
merges the runs, seeking each run to its next group after N outputs.
(3) The same merge without the salt joins what the salted merges left, at most N
rows a group and salt. A merge streams: it holds one batch, and of the group still
open only its best N rows so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of one run while runs are formed; bounds a Python worker's memory.
RUN_ROWS = 1 << 18
#: Salts of a group in the first merge; a hot group is spread over as many tasks.
SALTS = 16


class LoserTree:
    """Merges sorted sequences; `pop` gives the least key, `skip` moves the winner on.

    An inner node holds the loser of the match played there, so replacing the
    winner replays one path of log2(k) matches.
    """

    def __init__(self, runs: list[list[tuple]]) -> None:
        self.runs = runs
        self.at = [0] * len(runs)
        self.size = 1 << max(0, (len(runs) - 1).bit_length())
        self.losers = [-1] * self.size
        self.winner = self._build(1) if runs else -1

    def _key(self, run: int):
        if run < 0 or run >= len(self.runs) or self.at[run] >= len(self.runs[run]):
            return None
        return self.runs[run][self.at[run]]

    def _beats(self, a: int, b: int) -> bool:
        x, y = self._key(a), self._key(b)
        return y is None or (x is not None and x <= y)

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self._build(2 * node), self._build(2 * node + 1)
        won, lost = (a, b) if self._beats(a, b) else (b, a)
        self.losers[node] = lost
        return won

    def _replay(self, run: int) -> None:
        node, won = (run + self.size) >> 1, run
        while node:
            if not self._beats(won, self.losers[node]):
                self.losers[node], won = won, self.losers[node]
            node >>= 1
        self.winner = won

    def head(self):
        return self._key(self.winner)

    def skip(self, steps: int = 1) -> None:
        """Moves the winning run on by `steps` rows and replays its path."""
        run = self.winner
        self.at[run] += steps
        self._replay(run)


def merge_top(runs: list[list[tuple]], ends: list[list[int]], n: int) -> Iterator[tuple[int, int, int]]:
    """(run, row, place) of the first `n` rows of each group over sorted `runs`.

    A key is (group, order...); ends[r][i] is the row after the group of row i of
    run r, where that run goes on once the group has its `n` rows.
    """
    tree = LoserTree(runs)
    group, place = object(), 0
    while (key := tree.head()) is not None:
        run, row = tree.winner, tree.at[tree.winner]
        if key[0] != group:
            group, place = key[0], 0
        place += 1
        if place <= n:
            yield run, row, place
            tree.skip()
        else:
            tree.skip(ends[run][row] - row)


def _ordered(table: pa.Table, group: str, order: list[tuple[str, str]]) -> pa.Table:
    keys = [(group, "ascending"), *order]
    return table.take(pc.sort_indices(table, sort_keys=keys, null_placement="at_end"))


def _first(table: pa.Table, group: str, n: int) -> pa.Table:
    """The first n rows of each group of a sorted table."""
    if not table.num_rows:
        return table
    codes = table.column(group).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    rank = np.arange(len(codes)) - np.repeat(starts, np.diff(np.r_[starts, len(codes)]))
    return table.filter(pa.array(rank < n))


def _runs(group: str, order: list[tuple[str, str]], n: int, size: int):
    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush():
            table = _first(_ordered(pa.Table.from_batches(held), group, order), group, n)
            run = pa.array(np.full(table.num_rows, task * (1 << 31) + number, np.int64))
            place = pa.array(np.arange(table.num_rows, dtype=np.int64))
            return table.append_column("_run", run).append_column("_at", place).to_batches()

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= size:
                yield from flush()
                held, rows, number = [], 0, number + 1
        if rows:
            yield from flush()

    return form


def _best(table: pa.Table, group: str, order: list[tuple[str, str]], n: int) -> tuple[pa.Table, list[int]]:
    """The first n rows of each group of rows sorted by group, run and place in the run, in order, and their places."""
    names = table.column(group).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    codes = np.cumsum(np.r_[0, names[1:] != names[:-1]])
    run = table.column("_run").to_numpy()
    by_run = np.argsort(run, kind="stable")  # within a run the groups stay in order
    codes, run = codes[by_run], run[by_run]
    columns = [codes.tolist()]
    for name, way in order:
        values = table.column(name).take(pa.array(by_run)).to_pylist()
        sign = -1 if way == "descending" else 1
        columns.append([(v is None, 0 if v is None else sign * v) for v in values])
    keys = list(zip(*columns, strict=True))
    cuts = [*np.flatnonzero(np.r_[True, run[1:] != run[:-1]]).tolist(), len(run)]
    runs, ends = [], []
    for a, b in zip(cuts, cuts[1:], strict=False):
        runs.append(keys[a:b])
        ends.append(np.searchsorted(codes[a:b], codes[a:b], side="right").tolist())
    rows, places = [], []
    for r, row, place in merge_top(runs, ends, n):
        rows.append(int(by_run[cuts[r] + row]))
        places.append(place)
    return table.take(pa.array(rows, pa.int64())), places


def _merge(group: str, order: list[tuple[str, str]], n: int, last: bool):
    """Streams a bucket's runs, sorted by group: of the group still open only its best n rows so far are held."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, sent = TaskContext.get().partitionId(), 0
        held: pa.Table | None = None

        def emitted(table: pa.Table, places: list[int]) -> list[pa.RecordBatch]:
            nonlocal sent
            table = table.drop_columns(["_run", "_at"])
            if last:
                return table.append_column("place", pa.array(places, pa.int32())).to_batches()
            at = np.arange(sent, sent + table.num_rows, dtype=np.int64)
            sent += table.num_rows
            return table.append_column("_run", pa.array(np.full(table.num_rows, task, np.int64))).append_column("_at", pa.array(at)).to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = pa.Table.from_batches([batch])
            best, places = _best(fresh if held is None else pa.concat_tables([held, fresh]), group, order, n)
            closed = best.num_rows - places[-1]  # the places of the last group count its rows
            yield from emitted(best.slice(0, closed), places[:closed])
            held = best.slice(closed)
            held = held.set_column(held.schema.get_field_index("_run"), "_run", pa.array(np.full(held.num_rows, -1, np.int64))).combine_chunks()
        if held is not None:
            yield from emitted(held, list(range(1, held.num_rows + 1)))

    return merge


def top_n(df: DataFrame, group: str, order: list[tuple[str, str]], n: int, run_rows: int = RUN_ROWS, salts: int = SALTS) -> DataFrame:
    """The first `n` rows of each `group` by `order`, with their `place` from 1.

    `order`: (numeric column, "ascending" | "descending"); nulls come last; where
    all are equal, any of the equal rows may come first, so end with a unique
    column. Rows of a null group give nothing. A null or NaN in the first order
    column also leaves a row out: it has no score. Repeated rows count as rows. An
    empty input gives no row. Columns beyond `group` and `order` are not read, so
    clashing names do not matter (the result has group, order columns, place).
    """
    score = order[0][0]
    names = [group, *(name for name, _ in order)]
    rows = df.select(*names).filter(F.col(group).isNotNull() & F.col(score).isNotNull())
    if dict(rows.dtypes)[score] in ("double", "float"):
        rows = rows.filter(~F.isnan(score))
    schema = T.StructType([*rows.schema.fields, T.StructField("_run", T.LongType()), T.StructField("_at", T.LongType())])
    runs = rows.mapInArrow(_runs(group, order, n, run_rows), schema)
    salted = runs.repartition(F.col(group), F.col("_run") % salts).sortWithinPartitions(group, "_run", "_at").mapInArrow(_merge(group, order, n, False), schema)
    final = T.StructType([*rows.schema.fields, T.StructField("place", T.IntegerType())])
    return salted.repartition(F.col(group)).sortWithinPartitions(group, "_run", "_at").mapInArrow(_merge(group, order, n, True), final)


def chunk_ranking(chunks: DataFrame) -> DataFrame:
    """The ranking columns of pool chunks, read from the nested source."""
    return chunks.select(
        F.col("source.query").alias("query"), F.col("source.relevance_score").alias("relevance_score"), F.col("source.rank").alias("rank"), "row_id"
    )


def p2_found(chunks: DataFrame, n: int = 5) -> DataFrame:
    """query, place, row_id: the best `n` chunks of each query."""
    order = [("relevance_score", "descending"), ("rank", "ascending"), ("row_id", "ascending")]
    return top_n(chunk_ranking(chunks), "query", order, n).select("query", "place", "row_id")
