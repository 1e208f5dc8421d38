"""Mixing sources to target weights under a cap on repeats.

Capped water-filling: every source should give its share of the budget; a source
that would need more epochs than allowed is clamped there and its missing weight
goes to the others in proportion, until none is over. Epochs become whole
repetitions of all documents of the source and a seeded sample for the fraction:
documents fall into BUCKETS by a hash, whole buckets are taken up to the target,
and only the bucket at the edge is sorted, so a source of any size is sampled
without sorting it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpusloom.llm.tokens import token_counts
from corpusloom.sources.tables import cut

BUCKETS, SEED = 4096, 17


def water_fill(sizes: dict[str, int], weights: dict[str, float], caps: dict[str, float], budget: float) -> dict[str, float]:
    """Epochs of each source; sources without tokens or weight get 0.

    The total is `budget` unless all sources are clamped. Negative or missing
    weights and caps count as 0.
    """
    open_ = {s for s, w in weights.items() if (w or 0) > 0 and sizes.get(s, 0) > 0 and (caps.get(s) or 0) > 0}
    epochs = dict.fromkeys(weights, 0.0)
    left = float(budget)
    while open_:
        weight = sum(weights[s] for s in open_)
        want = {s: left * weights[s] / weight / sizes[s] for s in open_}
        over = {s for s in open_ if want[s] > caps[s]}
        if not over:
            epochs |= want
            break
        for s in over:
            epochs[s] = float(caps[s])
            left -= caps[s] * sizes[s]
        open_ -= over
    return epochs


def largest_budget(sizes: dict[str, int], weights: dict[str, float], caps: dict[str, float]) -> float:
    """The most tokens at which every source with tokens, weight and a cap gives its share and none is clamped."""
    usable = [s for s, w in weights.items() if (w or 0) > 0 and sizes.get(s, 0) > 0 and (caps.get(s) or 0) > 0]
    whole = sum(weights[s] for s in usable)
    return min((caps[s] * sizes[s] * whole / weights[s] for s in usable), default=0.0)


def mixture(documents: DataFrame, targets: DataFrame, tokenizer: str | None = None, budget: float | str | None = None, seed: int = SEED) -> DataFrame:
    """mix_name, source, doc_id, tokens, repeats: the documents chosen for each mix.

    `budget`: tokens of a mix; by default those of all its sources once over, which
    clamps small sources at their cap; "largest" for the most that meets every share.
    Documents of a null source, or of none of a mix, are not chosen; null doc_ids
    are left out; empty texts repeat with their source and weigh nothing; equal
    ids are separate rows. Empty tables give no row. `targets` is a fixed table of
    a few sources per mix.
    """
    sized = cut(token_counts(documents, tokenizer).filter("source is not null").withColumn("bucket", F.expr(f"cast(pmod(xxhash64(doc_id, {seed}L), {BUCKETS}) as int)")))
    wanted = [r for r in targets.select("mix_name", "source", "target_share", "max_repeats").collect() if r["mix_name"] is not None and r["source"] is not None]
    filled = sized.groupBy("source", "bucket").agg(F.sum("tokens").alias("tokens"))
    totals = {r["source"]: r["tokens"] for r in filled.groupBy("source").agg(F.sum("tokens").alias("tokens")).join(F.broadcast(targets.select("source").distinct()), "source").collect()}
    plan = []
    for mix in sorted({r["mix_name"] for r in wanted}):
        own = [r for r in wanted if r["mix_name"] == mix]
        weights = {r["source"]: float(r["target_share"] or 0) for r in own}
        caps = {r["source"]: float(r["max_repeats"] or 0) for r in own}
        if budget == "largest":
            room = largest_budget(totals, weights, caps)
        else:
            room = budget if budget is not None else sum(totals.get(s, 0) for s in weights)
        for source, epochs in water_fill(totals, weights, caps, room).items():
            whole = int(epochs + 1e-9)
            plan.append((mix, source, weights[source], int(caps[source]), epochs, whole, (epochs - whole if epochs - whole > 1e-9 else 0.0) * totals.get(source, 0)))
    schema = T.StructType([T.StructField(n, t()) for n, t in (("mix_name", T.StringType), ("source", T.StringType), ("target_share", T.DoubleType), ("max_repeats", T.IntegerType), ("epochs", T.DoubleType), ("whole", T.IntegerType), ("part_tokens", T.DoubleType))])
    planned = F.broadcast(documents.sparkSession.createDataFrame(plan, schema))
    before = Window.partitionBy("mix_name", "source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edges = filled.join(planned, "source").withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    edges = edges.select("mix_name", "source", "bucket", "before", (F.col("before") + F.col("tokens") <= F.col("part_tokens")).alias("all_in"), (F.col("before") < F.col("part_tokens")).alias("some_in"))
    rows = sized.join(planned, "source").join(F.broadcast(edges), ["mix_name", "source", "bucket"])
    order = Window.partitionBy("mix_name", "source", "bucket").orderBy(F.xxhash64(F.lit(seed + 1), F.col("doc_id")), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = rows.filter("some_in and not all_in").withColumn("upto", F.col("before") + F.sum("tokens").over(order) - F.col("tokens") / 2)
    columns = ["mix_name", "source", "doc_id", "tokens", "whole"]
    taken = edge.select(*columns, (F.col("upto") <= F.col("part_tokens")).cast("int").alias("part"))
    others = rows.filter("all_in or not some_in").select(*columns, F.col("all_in").cast("int").alias("part"))
    return others.unionByName(taken).select("mix_name", "source", "doc_id", "tokens", (F.col("whole") + F.col("part")).alias("repeats")).filter("repeats > 0")


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per mix and source: target and actual share of tokens, documents, tokens with repeats, least and most repeats of a
    document chosen, and whether the source is clamped: all of it as often as it may be."""
    each = mixed.groupBy("mix_name", "source").agg(F.count("*").alias("documents"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.min("repeats").alias("least_repeats"), F.max("repeats").alias("most_repeats"))
    whole = Window.partitionBy("mix_name")
    joined = targets.select("mix_name", "source", "target_share", "max_repeats").join(each, ["mix_name", "source"], "left").fillna(0, ["documents", "tokens", "least_repeats", "most_repeats"])
    share = F.round(F.try_divide(F.col("tokens").cast("double"), F.sum("tokens").over(whole)), 6)
    return joined.withColumn("actual_share", share).withColumn("clamped", (F.col("least_repeats") == F.col("max_repeats")) & (F.col("documents") > 0))
