"""Filling containers of several capacities with whole documents.

Documents are routed to the smallest tier that takes them whole; a document larger
than the largest capacity is split into full pieces of it and a rest that is
routed like a document. From the largest tier down, each tier's items are packed
best fit, largest first; then gaps are filled from shorter tiers, largest item
first. Full containers of a kind are dealt into step groups of nearly equal load.

Packing runs in shards of about SHARD items, cut by a hash of the document, hence
alike for any skew of sources or questions. A shard leaves at most one poorly
filled container of each kind, so the loss falls as SHARD grows and does not grow
with the data.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.tokens import token_counts

#: Items of a shard, and containers of a step group.
SHARD, STEP = 20_000, 8


class Sizes:
    """Items by size: take the largest of at most a given size in O(log n)."""

    def __init__(self, items: list[tuple[int, tuple]]) -> None:
        self.by: dict[int, list[tuple]] = {}
        for size, item in items:
            self.by.setdefault(size, []).append(item)
        self.sizes = sorted(self.by)
        for held in self.by.values():
            held.sort(reverse=True)

    def take(self, most: int) -> tuple[int, tuple] | None:
        k = bisect_right(self.sizes, most)
        if not k:
            return None
        size = self.sizes[k - 1]
        item = self.by[size].pop()
        if not self.by[size]:
            del self.by[size], self.sizes[k - 1]
        return size, item

    def __bool__(self) -> bool:
        return bool(self.sizes)


def pack(items: list[tuple[int, tuple]], capacities: list[int]) -> list[tuple[int, list[tuple[int, tuple]]]]:
    """Containers (capacity, [(size, item)]) of all items; sizes must not exceed the largest capacity."""
    tiers = sorted(capacities)
    pools = []
    low = -1
    for cap in tiers:
        pools.append(Sizes([(s, x) for s, x in items if low < s <= cap]))
        low = cap
    done: list[tuple[int, list[tuple[int, tuple]]]] = []
    for k in range(len(tiers) - 1, -1, -1):
        cap, made, gaps = tiers[k], [], []  # gaps: sorted (room, container)
        while (got := pools[k].take(cap)) is not None:
            size, item = got
            at = bisect_right(gaps, (size - 1, len(made)))
            if at < len(gaps):
                room, number = gaps.pop(at)
            else:
                room, number = cap, len(made)
                made.append([])
            made[number].append((size, item))
            if room - size:
                insort(gaps, (room - size, number))
        for room, number in reversed(gaps):  # the widest gap first, from the next shorter tier down
            for pool in reversed(pools[:k]):
                while room and (got := pool.take(room)) is not None:
                    made[number].append(got)
                    room -= got[0]
        done += [(cap, m) for m in made]
    return done


def deal(loads: list[int], step: int) -> list[int]:
    """A group for each container: groups of `step`, heaviest first to the lightest group that has room."""
    groups = -(-len(loads) // step) if loads else 0
    state = sorted((0, g, 0) for g in range(groups))
    out = [0] * len(loads)
    for k in sorted(range(len(loads)), key=lambda k: (-loads[k], k)):
        load, g, n = state.pop(0)
        out[k] = g
        if n + 1 < step:
            insort(state, (load + loads[k], g, n + 1))
    return out


_SCHEMA = "doc_id long, piece int, tokens long, container_kind string, capacity_tokens int, container_id string, place int, step_group string"
_FIELDS = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string()]


def _packer(kinds: dict[int, str], step: int, mark: str):
    largest = max(kinds)

    def shard(number: int, docs: list[tuple[int, int]]) -> list[tuple]:
        items = []
        for doc, tokens in docs:
            full, rest = divmod(tokens, largest) if tokens > largest else (0, tokens)
            items += [(largest, (doc, p)) for p in range(full)]
            if rest or not full:
                items.append((rest, (doc, full)))
        made = pack(items, list(kinds))
        rows = []
        for cap in sorted(kinds, reverse=True):
            own = [m for c, m in made if c == cap]
            groups = deal([sum(s for s, _ in m) for m in own], step)
            for k, m in enumerate(own):
                name = f"{mark}{kinds[cap]}-{number}-{k}"
                rows += [(doc, piece, size, kinds[cap], cap, name, place, f"{mark}{kinds[cap]}-{number}-{groups[k]}") for place, (size, (doc, piece)) in enumerate(m)]
        return rows

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, docs = None, []

        def emit():
            columns = list(zip(*shard(current, docs), strict=True)) or [[]] * len(_FIELDS)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _FIELDS, strict=True)], names=[x.split()[0] for x in _SCHEMA.split(", ")])

        for batch in batches:
            for number, doc, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number != current:
                    if docs:
                        yield emit()
                    current, docs = number, []
                docs.append((doc, tokens))
        if docs:
            yield emit()

    return work


def packed(sizes: DataFrame, kinds: dict[int, str], shards: int, step: int = STEP, mark: str = "") -> DataFrame:
    """Assignment of every document (doc_id, tokens) to containers of the given capacities."""
    rows = sizes.select(F.expr(f"cast(pmod(xxhash64(doc_id), {shards}) as int)").alias("shard"), "doc_id", "tokens")
    return rows.repartition(shards, "shard").sortWithinPartitions("shard", "doc_id").mapInArrow(_packer(kinds, step, mark), _SCHEMA)


def _kinds(pack_sizes: DataFrame) -> dict[int, str]:
    """Capacities by name: a fixed table of a few rows."""
    return {int(r["capacity_tokens"]): r["container_kind"] for r in pack_sizes.select("container_kind", "capacity_tokens").filter("capacity_tokens > 0 and container_kind is not null").collect()}


def hierarchical(documents: DataFrame, pack_sizes: DataFrame, tokenizer: str | None = None, shard: int = SHARD, step: int = STEP) -> DataFrame:
    """One row per document and piece: its container, place and step group; every document once.

    Empty texts take no room but are placed; null doc_ids are left out; repeated
    rows are placed as often as they come; an empty table, or one without
    capacities, gives no row. Extra columns are not read.
    """
    kinds = _kinds(pack_sizes)
    sizes = token_counts(documents, tokenizer)
    if not kinds:
        return documents.sparkSession.createDataFrame([], _SCHEMA)
    return packed(sizes, kinds, max(1, -(-documents.count() // shard)), step)


def by_capacity(documents: DataFrame, pack_sizes: DataFrame, tokenizer: str | None = None, shard: int = SHARD, step: int = STEP) -> DataFrame:
    """The same for each capacity by itself: all documents in containers of every kind."""
    kinds = _kinds(pack_sizes)
    sizes = token_counts(documents, tokenizer)
    shards = max(1, -(-documents.count() // shard))
    out = documents.sparkSession.createDataFrame([], _SCHEMA)
    for cap, name in sorted(kinds.items()):
        out = out.unionByName(packed(sizes, {cap: name}, shards, step, "all-"))
    return out


def fill_report(assignment: DataFrame) -> DataFrame:
    """container_kind, containers, documents, tokens, fill: how full the containers are."""
    each = assignment.groupBy("container_kind", "capacity_tokens", "container_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"))
    return each.groupBy("container_kind", "capacity_tokens").agg(
        F.count("*").alias("containers"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"),
        F.round(F.sum("tokens") / (F.count("*") * F.col("capacity_tokens")), 6).alias("fill"), F.min("tokens").alias("least_tokens"),
    )
