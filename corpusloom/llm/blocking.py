"""Pairs of two sides: all that share enough (`overlapping`), or those that share what is rare (`rare_pairs`).

`overlapping` leaves out no pair. Each record stands, for each of its tokens, with
the tokens that are more frequent; a pair is found where its rarest common token
is, and one of the two must have enough weight from there on. Records of one
token are compared in cells of BLOCK by BLOCK, however many they are.

`rare_pairs` bounds the keys of a record. A token with at most `bucket` pairs of records is a key by itself. Of its more
frequent tokens a record takes the `rare` rarest and has every combination of two or
more of them as a key; combinations with at most `bucket` pairs join. So candidates
grow with the records and not with their square, whatever the frequency of a single
token, and no frequency rules a token out. A combination of `rare` tokens joins even
if it is frequent, as does, with `whole`, a shorter one that is all a record has.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.tables import broadcast_if_small, cut, stored


#: Records of a side in a cell; known tokens of a record beyond which it is joined token by token; columns of a cell's matrix, and those that rarer tokens share.
BLOCK, LONG, COLUMNS, SHARED = 2048, 64, 384, 128
#: Pairs up to which a cell is compared pair by pair.
FEW = 1024
_PAIRS = ["rec_a", "rec_b", "shared", "total_a", "total_b"]


class _Rows:
    """The rows of whole cells, with their tokens as padded arrays."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.key, self.rec, self.left, self.short, self.total, self.share = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:6])
        size = pc.list_value_length(batch.column(6)).to_numpy(zero_copy_only=False)
        self.there = np.arange(size.max()) < size[:, None]
        self.token, self.weight = np.zeros(self.there.shape, np.int64), np.zeros(self.there.shape, np.int64)
        self.token[self.there], self.weight[self.there] = (c.flatten().to_numpy(zero_copy_only=False) for c in batch.columns[6:8])

    def found(self, a: np.ndarray, b: np.ndarray, shared: np.ndarray) -> list[np.ndarray]:
        keep = shared >= self.share[b] * np.minimum(self.total[a], self.total[b]) - 1e-9
        a, b = a[keep], b[keep]
        return [self.rec[a], self.rec[b], shared[keep], self.total[a], self.total[b]]

    def one_by_one(self, a: np.ndarray, b: np.ndarray) -> Iterator[list[np.ndarray]]:
        """Those of the pairs of rows that share enough."""
        step = max(1, (1 << 22) // self.token.shape[1] ** 2)
        for k in range(0, len(a), step):
            x, y = a[k : k + step], b[k : k + step]
            same = (self.token[x][:, :, None] == self.token[y][:, None, :]) & self.there[y][:, None, :]
            yield self.found(x, y, (same.any(2) * self.weight[x]).sum(1))

    def by_matrix(self, a: np.ndarray, b: np.ndarray) -> Iterator[list[np.ndarray]]:
        """The same for all of `a` with all of `b`, by a product of matrices; where tokens share a column it only bounds the sum from above."""
        ours, theirs = self.there[a], self.there[b]
        x, often = np.unique(self.token[a][ours], return_counts=True)
        both = np.isin(x, self.token[b][theirs])
        x, often = x[both], often[both]
        column, exact = np.arange(len(x)), len(x) <= COLUMNS
        if not exact:
            column[np.argsort(-often, kind="stable")] = np.r_[np.arange(COLUMNS - SHARED), COLUMNS - SHARED + np.arange(len(x) - COLUMNS + SHARED) % SHARED]
        width = min(len(x), COLUMNS)

        def matrix(rows: np.ndarray, there: np.ndarray, weight: np.ndarray) -> np.ndarray:
            token, at = self.token[rows][there], np.nonzero(there)[0]
            place = np.minimum(np.searchsorted(x, token), len(x) - 1)
            known = x[place] == token
            return np.bincount(at[known] * width + column[place[known]], weights=weight[there][known], minlength=len(rows) * width).reshape(len(rows), width).astype(np.float32)

        product = matrix(a, ours, self.weight[a]) @ matrix(b, theirs, np.ones(theirs.shape)).T
        need = np.minimum(self.total[a].astype(np.float32)[:, None], self.total[b].astype(np.float32)[None, :]) * self.share[b].astype(np.float32)[None, :]
        i, j = np.nonzero(product >= need * np.float32(0.9999))  # rounding must not lose a pair
        if exact:
            yield self.found(a[i], b[j], product[i, j].astype(np.int64))
        else:
            yield from self.one_by_one(a[i], b[j])

    def pairs(self) -> Iterator[list[np.ndarray]]:
        starts = np.flatnonzero(np.r_[True, self.key[1:] != self.key[:-1]])
        x, y = [], []
        for begin, end in zip(starts.tolist(), [*starts[1:].tolist(), len(self.key)], strict=True):
            left, short = self.left[begin:end], self.short[begin:end]
            for mine, others in ((left & short, ~left), (left & ~short, ~left & short)):  # one of the two must be able to be the shorter
                a, b = begin + np.flatnonzero(mine), begin + np.flatnonzero(others)
                if len(a) * len(b) > FEW:
                    yield from self.by_matrix(a, b)
                elif len(a) and len(b):
                    x.append(np.repeat(a, len(b)))
                    y.append(np.tile(b, len(a)))
        if x:
            yield from self.one_by_one(np.concatenate(x), np.concatenate(y))


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell: the pairs of each cell that share enough. Only the cell still open is held."""

    def out(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for columns in _Rows(batch).pairs():
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=_PAIRS)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        start = int(np.searchsorted(key, key[-1]))  # where the last cell begins
        if start or (held and held[0].column(0)[-1].as_py() != key[0]):
            yield from out(pa.concat_batches([*held, batch.slice(0, start)]))
            held = []
        held.append(batch.slice(start))
    if held:
        yield from out(pa.concat_batches(held))


def overlapping(tokens: DataFrame, least: float) -> DataFrame:
    """All (rec_a, rec_b, shared, total_a, total_b), a of the left side, whose common tokens weigh `shared`, which is at
    least b's `share` of the lighter one's total.

    `tokens`: rec long, left boolean, token long, weight int (the token's, above 0), total long (of all the record's
    tokens), share double (`least` or more). Of rows of one record that differ the least total and share count.
    """
    tokens = stored(tokens)  # read twice
    count = tokens.groupBy("token").agg(F.count_if("left").alias("na"), F.count_if(~F.col("left")).alias("nb")).filter("na > 0 and nb > 0")
    placed = tokens.join(broadcast_if_small(stored(count)), "token")
    d = F.array_sort(F.collect_set(F.struct((F.col("na") * F.col("nb")).alias("often"), "token", "weight", "na", "nb")))  # rarest first
    listed = stored(placed.groupBy("rec", "left").agg(F.min("total").alias("total"), F.min("share").alias("share"), d.alias("d")))
    rest = lambda c: F.expr(f"transform(slice(d, i + 1, size(d)), x -> x.{c})")
    rows = listed.filter(F.size("d") <= LONG).select("*", F.posexplode("d").alias("i", "x"))
    rows = rows.select("*", rest("token").alias("token"), rest("weight").alias("weight"), F.ceil(F.col("x.na") / BLOCK).alias("ga"), F.ceil(F.col("x.nb") / BLOCK).alias("gb"))
    enough = F.expr("aggregate(weight, 0L, (s, w) -> s + w)") >= F.when(F.col("left"), least).otherwise(F.col("share")) * F.col("total") - 1e-9
    own = F.pmod(F.xxhash64("rec"), F.when(F.col("left"), F.col("ga")).otherwise(F.col("gb")))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0L, if(left, gb, ga) - 1)")))
    cell = F.xxhash64("x.token", F.when(F.col("left"), own).otherwise(F.col("other")), F.when(F.col("left"), F.col("other")).otherwise(own))
    rows = rows.select(cell.alias("key"), "rec", "left", enough.alias("short"), "total", "share", "token", "weight")
    found = rows.repartition("key").sortWithinPartitions("key").mapInArrow(_cells, ", ".join(f"{c} long" for c in _PAIRS))
    found = found.groupBy("rec_a", "rec_b").agg(*(f(c).alias(c) for f, c in zip((F.max, F.min, F.min), _PAIRS[2:], strict=True)))
    long = F.size("d") > LONG
    if not listed.filter(long).isEmpty():
        flat = listed.select("rec", "left", "total", "share", long.alias("long"), F.explode("d").alias("x")).select("*", "x.token", "x.weight")
        side = lambda keep, s: flat.filter(keep).select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("rec", "total", "share", "weight", "long")])
        joined = side("left", "a").join(side("not left", "b"), "token").filter("long_a or long_b").groupBy("rec_a", "rec_b")
        joined = joined.agg(F.sum("weight_a").alias("shared"), F.min("total_a").alias("total_a"), F.min("total_b").alias("total_b"), F.min("share_b").alias("share"))
        found = found.unionByName(joined.filter(F.col("shared") >= F.col("share") * F.least("total_a", "total_b") - 1e-9).drop("share"))
    return found


def _combined(rare: int, whole: bool):
    """The combinations of two or more of the tokens `d`, as struct(key, last): last for those that join in any case."""
    size = F.size("d")
    last = lambda n: (size == n) if whole else F.lit(n == rare)
    made = [F.when(size > ix[-1], F.struct(F.xxhash64(F.lit(len(ix)), *[F.col("d")[i] for i in ix]).alias("key"), last(len(ix)).alias("last"))) for n in range(2, rare + 1) for ix in combinations(range(rare), n)]
    one = F.when(size == 1, F.struct(F.xxhash64(F.lit(1), F.col("d")[0]).alias("key"), F.lit(whole).alias("last")))
    return F.array_compact(F.array(one, *made))


def _runs(bucket: int):
    """Rows sorted by key: the pairs (rec_a, rec_b, null) of each small bucket, and of a large one the rows that join in any case, (rec, null, key) or (null, rec, key) by side."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: list[np.ndarray] | None = None

        def pairs(rows: list[np.ndarray], last: bool):
            key, rec, left, final = rows
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            ends = np.r_[starts[1:], len(key)]
            na = np.add.reduceat(left.astype(np.int64), starts)
            product = na * (ends - starts - na)
            large = np.repeat(product > bucket, ends - starts) & final
            keep = None
            if not last:  # the run still open waits; of one that is large already, a few rows that show it
                keep = [r[starts[-1] :] for r in rows]
                if product[-1] > bucket:
                    some = np.r_[np.flatnonzero(keep[2])[: bucket + 1], np.flatnonzero(~keep[2])[: bucket + 1]]
                    keep = [r[some] for r in keep]
                product[-1] = 0
            a_, b_ = [], []
            for k in np.flatnonzero((product > 0) & (product <= bucket)).tolist():
                mine, side = rec[starts[k] : ends[k]], left[starts[k] : ends[k]]
                x, y = mine[side], mine[~side]
                a_.append(np.repeat(x, len(y)))
                b_.append(np.tile(y, len(x)))
            none = np.zeros(0, np.int64)
            a, b = np.concatenate([none, *a_]), np.concatenate([none, *b_])
            n, of, side = len(a), rec[large], left[large]
            no = np.zeros(n, bool)
            columns = [pa.array(np.r_[a, of], mask=np.r_[no, ~side]), pa.array(np.r_[b, of], mask=np.r_[no, side]), pa.array(np.r_[np.zeros(n, np.int64), key[large]], mask=np.r_[~no, np.zeros(len(of), bool)])]
            return pa.RecordBatch.from_arrays(columns, names=["rec_a", "rec_b", "key"]), keep

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if carry is not None:
                rows = [np.concatenate([x, y]) for x, y in zip(carry, rows, strict=True)]
            out, carry = pairs(rows, False)
            yield out
        if carry is not None:
            yield pairs(carry, True)[0]

    return work


def rare_pairs(tokens: DataFrame, bucket: int, rare: int, whole: bool = True) -> DataFrame:
    """Distinct (rec_a, rec_b), a of the left side, b of the other, that share a small bucket.

    `tokens`: rec long (unique within its side), left boolean, token long; a repeated
    row only makes its token look more frequent. Records without a token of the other
    side have no pair.
    """
    sides = [F.count_if("left").alias("na"), F.count_if(~F.col("left")).alias("nb")]
    tokens = stored(tokens)  # read three times
    count = tokens.groupBy("token").agg(*sides).filter("na > 0 and nb > 0").select("token", (F.col("na") * F.col("nb")).alias("often"))
    placed = tokens.join(broadcast_if_small(stored(count)), "token")
    single = placed.filter(F.col("often") <= bucket).select(F.xxhash64(F.lit(0), "token").alias("key"), "rec", "left", F.lit(False).alias("last"))
    # tokens in one global order, rarest first, so that the same combination has the same key in either record
    listed = placed.filter(F.col("often") > bucket).groupBy("rec", "left").agg(F.expr(f"transform(slice(array_sort(collect_list(struct(often, token))), 1, {rare}), x -> x.token)").alias("d"))
    combined = listed.select("rec", "left", F.explode(_combined(rare, whole)).alias("k")).select("k.key", "rec", "left", "k.last")
    rows = single.unionByName(combined)
    found = cut(rows.repartition("key").sortWithinPartitions("key").mapInArrow(_runs(bucket), "rec_a long, rec_b long, key long"))
    pairs = found.filter("key is null").select("rec_a", "rec_b")
    large = found.filter("key is not null")
    if not large.isEmpty():
        a, b = large.filter("rec_a is not null").select("key", "rec_a").distinct(), large.filter("rec_b is not null").select("key", "rec_b").distinct()
        if whole:  # rows that join such a one without being one themselves
            both = combined.join(broadcast_if_small(large.select("key").distinct()), "key").filter("not last")
            pairs = pairs.unionByName(a.join(both.filter("not left").select("key", F.col("rec").alias("rec_b")), "key").select("rec_a", "rec_b"))
            pairs = pairs.unionByName(b.join(both.filter("left").select("key", F.col("rec").alias("rec_a")), "key").select("rec_a", "rec_b"))
        pairs = pairs.unionByName(a.join(b, "key").select("rec_a", "rec_b"))
    return pairs.distinct()
