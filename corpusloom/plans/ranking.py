"""Retrieval, selection and ranking-quality queries.

Bindings: a retrieval query is `source.query` of pool chunks, its arms are
providers; a chunk of relevance 0.6 or more is relevant; embeddings share a
label where they are alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import metrics as M
from corpusloom.functions import text as X
from corpusloom.operators import dedup, retrieval
from corpusloom.sources.tables import table

K = 4


def _ranked(s: SparkSession, d: str) -> DataFrame:
    """Chunks with a query and a score: query, provider, row_id, score, place in provider order."""
    c = table(s, d, "pool_chunks").select(
        F.col("source.query").alias("query"), F.col("source.provider").alias("provider"), "source_fingerprint", "question_id", "chunk_id", "row_id",
        F.col("source.rank").alias("rank"), F.col("source.relevance_score").alias("score"),
    )
    return c.filter(F.col("query").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))


def _placed(s: SparkSession, d: str) -> DataFrame:
    """The first 10 chunks of each query by score; the limit is the ranking's depth."""
    w = Window.partitionBy("query").orderBy(F.desc("score"), F.col("rank").asc_nulls_last(), "row_id")
    return _ranked(s, d).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= 10)


def topk_cosine(s: SparkSession, d: str) -> DataFrame:
    """The 5 nearest embeddings of every one whose id is divisible by 100, against all."""
    e = table(s, d, "embeddings")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = retrieval.top_k_similar(q, e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector")), 5)
    return found.select("query_id", "item_id", "place", F.round("similarity", 6).alias("similarity"))


def similar_precision(s: SparkSession, d: str) -> DataFrame:
    """Precision and nDCG at 5 of the nearest embeddings, where the same label is relevant."""
    e = table(s, d, "embeddings")
    names = e.select("vec_id", "label")
    found = topk_cosine(s, d).join(names.withColumnRenamed("vec_id", "query_id").withColumnRenamed("label", "ql"), "query_id").join(names.withColumnRenamed("vec_id", "item_id"), "item_id")
    same = F.col("label") == F.col("ql")
    return found.groupBy("query_id").agg(M.precision_at(same, F.col("place"), 5).alias("precision_at_5"), M.ndcg_at(same, F.col("place"), 5).alias("ndcg_at_5"))


def ranking_quality(s: SparkSession, d: str) -> DataFrame:
    """Per query: precision and nDCG among the first 4 by score, relevance 0.6 or more."""
    r = _placed(s, d)
    good = F.col("score") >= 0.6
    return r.groupBy("query").agg(M.precision_at(good, F.col("place"), K).alias("precision_at_k"), M.ndcg_at(good, F.col("place"), K).alias("ndcg_at_k"), F.count_if(F.col("place") <= K).alias("inspected"))


def statement_recall(s: SparkSession, d: str) -> DataFrame:
    """Per question: expected statements, and those half of whose long words stand in one chunk of its pool."""
    q = table(s, d, "question_items").filter("expected_evidence is not null").select("question_id", F.explode("expected_evidence").alias("statement")).distinct()
    c = table(s, d, "pool_chunks").select("question_id", X.long_words(F.col("text")).alias("words")).distinct()
    wanted = X.long_words(F.col("statement"))
    found = q.join(c, "question_id").filter(F.size(F.array_intersect("words", wanted)) * 2 >= F.size(wanted)).select("question_id", "statement").distinct().withColumn("hit", F.lit(1))
    joined = q.join(found, ["question_id", "statement"], "left")
    return joined.groupBy("question_id").agg(F.count("*").alias("expected"), F.count("hit").alias("covered"), M.ratio(F.count("hit"), F.count("*")).alias("recall"))


def source_cap(s: SparkSession, d: str) -> DataFrame:
    """The first 5 chunks of each query with at most 2 of a source, then backfilled."""
    order = [F.desc("score"), F.col("rank").asc_nulls_last(), F.col("row_id")]
    return retrieval.capped_per_source(_ranked(s, d), "query", "source_fingerprint", order, 2, 5).select("query", "place", "row_id")


def selection_strategies(s: SparkSession, d: str) -> DataFrame:
    """Plain top 4 against the source-capped one: mean precision and distinct sources."""
    plain = _placed(s, d).filter(F.col("place") <= K).select(F.lit("topk").alias("strategy"), "query", "place", "score", "source_fingerprint")
    order = [F.desc("score"), F.col("rank").asc_nulls_last(), F.col("row_id")]
    capped = retrieval.capped_per_source(_ranked(s, d), "query", "source_fingerprint", order, 2, K).select(F.lit("source_cap").alias("strategy"), "query", "place", "score", "source_fingerprint")
    each = plain.unionByName(capped).groupBy("strategy", "query").agg(F.avg((F.col("score") >= 0.6).cast("double")).alias("p"), F.countDistinct("source_fingerprint").alias("n"))
    return each.groupBy("strategy").agg(F.count("*").alias("queries"), F.round(F.avg("p"), 4).alias("precision"), F.round(F.avg("n"), 4).alias("distinct_sources"))


def first_use_labels(s: SparkSession, d: str) -> DataFrame:
    """Per question, sources labelled S1, S2, ... by first use among its chunks."""
    c = table(s, d, "pool_chunks").select("question_id", "source_fingerprint", "row_id").filter("question_id is not null and source_fingerprint is not null")
    return retrieval.first_use_labels(c, "question_id", "source_fingerprint", "row_id").select("question_id", "source_fingerprint", "label", "uses")


def passage_allocation(s: SparkSession, d: str) -> DataFrame:
    """30 passages dealt over the questions of each category, false premises first."""
    q = table(s, d, "question_items").filter("category is not null").select("category", "question_id", F.coalesce("premise_is_false", F.lit(False)).cast("int").alias("core")).groupBy("category", "question_id").agg(F.max("core").alias("core"))
    return retrieval.allocated(q, "category", "core", "question_id", 30).select("category", "question_id", "passages")


def web_first_wins(s: SparkSession, d: str) -> DataFrame:
    """Per query, the first result of each fingerprint by rank, and how many it stands for."""
    w = table(s, d, "web_results").filter("query is not null").select("query", "fingerprint", "rank", "web_key")
    return dedup.first_wins(w, ["query", "fingerprint"], [F.coalesce("rank", F.lit(2**31 - 1)), F.col("web_key")]).select("query", "fingerprint", "web_key", "copies")


def latest_items(s: SparkSession, d: str) -> DataFrame:
    """Of items exported twice, the last by creation, version and wording."""
    q = table(s, d, "question_items").select("question_id", "set_name", "created", "version", "question")
    order = [F.coalesce("created", F.lit("")), F.coalesce("version", F.lit("")), F.coalesce("question", F.lit(""))]
    return dedup.latest(q, ["question_id"], order)


def index_upsert(s: SparkSession, d: str) -> DataFrame:
    """Counts of an idempotent upsert of all chunks into an index that holds the abstracts."""
    c = table(s, d, "pool_chunks").select("chunk_id", "row_id", "depth")
    return dedup.upsert(c.filter("depth = 'abstract'"), c, "chunk_id", [F.col("row_id")])[1]


def support_by_arm(s: SparkSession, d: str) -> DataFrame:
    """Per provider: judged chunks, supported share with its interval, macro mean over questions and micro rate."""
    r = _ranked(s, d).filter("question_id is not null")
    good = F.col("score") >= 0.6
    each = r.groupBy("provider", "question_id").agg(F.count("*").alias("judged"), F.count_if(good).alias("supported")).withColumn("rate", M.ratio(F.col("supported"), F.col("judged")))
    out = each.groupBy("provider").agg(F.count("*").alias("questions"), F.sum("judged").alias("judged"), F.sum("supported").alias("supported"), F.round(F.avg("rate"), 4).alias("macro"))
    w = M.wilson(F.col("supported"), F.col("judged"))
    return out.select("provider", "questions", "judged", "supported", "macro", M.ratio(F.col("supported"), F.col("judged")).alias("micro"), w["low"].alias("low"), w["high"].alias("high"))


def matched_pair(s: SparkSession, d: str) -> DataFrame:
    """webscout against newsgrid on the questions both have chunks for: macro, micro, difference, and what was left out."""
    r = _ranked(s, d).filter("question_id is not null and provider in ('webscout', 'newsgrid')")
    each = r.groupBy("question_id").agg(
        *[F.count_if(F.col("provider") == a).alias(f"n_{a}") for a in ("webscout", "newsgrid")],
        *[F.count_if((F.col("provider") == a) & (F.col("score") >= 0.6)).alias(f"s_{a}") for a in ("webscout", "newsgrid")],
    )
    both = (F.col("n_webscout") > 0) & (F.col("n_newsgrid") > 0)
    rate = lambda a: F.when(both, F.round(F.col(f"s_{a}") / F.nullif(F.col(f"n_{a}"), F.lit(0)), 4))
    out = each.agg(
        F.count_if(both).alias("matched"), F.count_if(~both).alias("excluded"), F.round(F.avg(rate("webscout")), 4).alias("macro_a"), F.round(F.avg(rate("newsgrid")), 4).alias("macro_b"),
        M.ratio(F.sum(F.when(both, F.col("s_webscout"))), F.sum(F.when(both, F.col("n_webscout")))).alias("micro_a"),
        M.ratio(F.sum(F.when(both, F.col("s_newsgrid"))), F.sum(F.when(both, F.col("n_newsgrid")))).alias("micro_b"),
    )
    return out.withColumn("difference", F.round(F.col("macro_a") - F.col("macro_b"), 4)).withColumn(
        "direction", F.when(F.col("macro_a") > F.col("macro_b"), "better").when(F.col("macro_a") < F.col("macro_b"), "worse").otherwise("equal")
    )


def classifier_report(s: SparkSession, d: str) -> DataFrame:
    """Category in a question's id against the stored one: true positives, predicted, actual, precision, recall."""
    q = table(s, d, "question_items").filter("category is not null").select(F.regexp_extract("question_id", r"^[a-z]+-(.+)-\d+$", 1).alias("said"), "category")
    both = q.select(F.col("said").alias("label"), F.lit(1).alias("p"), F.lit(0).alias("a"), (F.col("said") == F.col("category")).cast("int").alias("t")).unionByName(
        q.select(F.col("category").alias("label"), F.lit(0).alias("p"), F.lit(1).alias("a"), F.lit(0).alias("t"))
    )
    g = both.groupBy("label").agg(F.sum("t").alias("tp"), F.sum("p").alias("predicted"), F.sum("a").alias("actual"))
    return g.select("label", "tp", "predicted", "actual", M.ratio(F.col("tp"), F.col("predicted")).alias("precision"), M.ratio(F.col("tp"), F.col("actual")).alias("recall"))


def depth_pivot(s: SparkSession, d: str) -> DataFrame:
    """Chunks per provider, one column a depth."""
    c = table(s, d, "pool_chunks").select(F.col("source.provider").alias("provider"), "depth")
    return c.groupBy("provider").pivot("depth", ["metadata", "snippet", "abstract", "full_text"]).agg(F.count(F.lit(1))).fillna(0)


QUERIES = {
    f.__name__: f
    for f in (topk_cosine, similar_precision, ranking_quality, statement_recall, source_cap, selection_strategies, first_use_labels, passage_allocation, web_first_wins, latest_items, index_upsert, support_by_arm, matched_pair, classifier_report, depth_pivot)
}

_R = """r AS (SELECT source.query AS query, source.provider AS provider, source_fingerprint, question_id, chunk_id, row_id, source.rank AS rank, source.relevance_score AS score
  FROM pool_chunks WHERE source.query IS NOT NULL AND source.relevance_score IS NOT NULL AND NOT isnan(source.relevance_score))"""
_P = "placed AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, rank ASC NULLS LAST, row_id) AS place FROM r)"
_CAP = "capped AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY w > 2, score DESC, rank ASC NULLS LAST, row_id) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query, source_fingerprint ORDER BY score DESC, rank ASC NULLS LAST, row_id) AS w FROM r))"
_NEAR = """near AS (SELECT q.vec_id AS query_id, e.vec_id AS item_id, q.label AS ql, e.label AS label,
    list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS sim FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0),
  top AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, item_id) AS INTEGER) AS place FROM near)"""
_NDCG = "round(CASE WHEN {hits} > 0 THEN {gain} / list_sum(list_transform(range(1, CAST({hits} AS BIGINT) + 1), lambda i: 1 / log2(i + 1))) END, 4)"


def _ndcg(good: str, k: int) -> str:
    hits = f"count(*) FILTER (WHERE ({good}) AND place <= {k})"
    return _NDCG.format(hits=hits, gain=f"sum(CASE WHEN ({good}) AND place <= {k} THEN 1 / log2(place + 1) ELSE 0 END)")


ORACLE = {
    "topk_cosine": f"WITH {_NEAR} SELECT query_id, item_id, place, round(sim, 6) AS similarity FROM top WHERE place <= 5",
    "similar_precision": f"WITH {_NEAR} SELECT query_id, round(avg(CASE WHEN label = ql THEN 1.0 ELSE 0.0 END), 4) AS precision_at_5, {_ndcg('label = ql', 5)} AS ndcg_at_5 FROM top WHERE place <= 5 GROUP BY query_id",
    "ranking_quality": f"WITH {_R}, {_P} SELECT query, round(count(*) FILTER (WHERE score >= 0.6 AND place <= 4) / count(*) FILTER (WHERE place <= 4), 4) AS precision_at_k, {_ndcg('score >= 0.6', 4)} AS ndcg_at_k, count(*) FILTER (WHERE place <= 4) AS inspected FROM placed GROUP BY query",
    "statement_recall": """WITH q AS (SELECT DISTINCT question_id, unnest(expected_evidence) AS statement FROM question_items), h AS (SELECT DISTINCT q.question_id, statement, 1 AS hit FROM q JOIN pool_chunks c ON c.question_id = q.question_id AND len(list_intersect(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: length(x) >= 7)), list_distinct(list_filter(string_split_regex(lower(statement), '[^a-z0-9]+'), lambda x: length(x) >= 7)))) * 2 >= len(list_distinct(list_filter(string_split_regex(lower(statement), '[^a-z0-9]+'), lambda x: length(x) >= 7))))
      SELECT q.question_id, count(*) AS expected, count(hit) AS covered, round(count(hit) / count(*), 4) AS recall FROM q LEFT JOIN h USING (question_id, statement) GROUP BY q.question_id""",
    "source_cap": f"WITH {_R}, {_CAP} SELECT query, CAST(place AS INTEGER) AS place, row_id FROM capped WHERE place <= 5",
    "selection_strategies": f"""WITH {_R}, {_P}, {_CAP}, u AS (SELECT 'topk' AS strategy, query, score, source_fingerprint FROM placed WHERE place <= 4 UNION ALL SELECT 'source_cap', query, score, source_fingerprint FROM capped WHERE place <= 4),
      e AS (SELECT strategy, query, avg(CASE WHEN score >= 0.6 THEN 1.0 ELSE 0.0 END) AS p, count(DISTINCT source_fingerprint) AS n FROM u GROUP BY ALL)
      SELECT strategy, count(*) AS queries, round(avg(p), 4) AS precision, round(avg(n), 4) AS distinct_sources FROM e GROUP BY strategy""",
    "first_use_labels": """WITH f AS (SELECT question_id, source_fingerprint, min(row_id) AS first_use, count(*) AS uses FROM pool_chunks WHERE question_id IS NOT NULL AND source_fingerprint IS NOT NULL GROUP BY ALL)
      SELECT question_id, source_fingerprint, 'S' || dense_rank() OVER (PARTITION BY question_id ORDER BY first_use, source_fingerprint) AS label, uses FROM f""",
    "passage_allocation": """WITH q AS (SELECT category, question_id, max(CAST(coalesce(premise_is_false, false) AS INTEGER)) AS core FROM question_items WHERE category IS NOT NULL GROUP BY ALL),
      n AS (SELECT *, count(*) OVER (PARTITION BY category) AS n, row_number() OVER (PARTITION BY category ORDER BY core DESC, question_id) AS place FROM q)
      SELECT category, question_id, CAST(30 // n + CASE WHEN place <= 30 % n THEN 1 ELSE 0 END AS INTEGER) AS passages FROM n""",
    "web_first_wins": """WITH w AS (SELECT query, fingerprint, web_key, row_number() OVER (PARTITION BY query, fingerprint ORDER BY coalesce(rank, 2147483647), web_key) AS n, count(*) OVER (PARTITION BY query, fingerprint) AS copies FROM web_results WHERE query IS NOT NULL)
      SELECT query, fingerprint, web_key, copies FROM w WHERE n = 1""",
    "latest_items": """SELECT question_id, set_name, created, version, question FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY coalesce(created, '') DESC, coalesce(version, '') DESC, coalesce(question, '') DESC) AS n FROM question_items) WHERE n = 1""",
    "index_upsert": """WITH b AS (SELECT chunk_id, count(*) AS copies FROM pool_chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id), p AS (SELECT DISTINCT chunk_id, 1 AS there FROM pool_chunks WHERE depth = 'abstract')
      SELECT CAST(sum(copies) AS BIGINT) AS requested, count(*) FILTER (WHERE there IS NULL) AS new, count(there) AS present, CAST(sum(copies - 1) AS BIGINT) AS duplicate FROM b LEFT JOIN p USING (chunk_id)""",
    "support_by_arm": f"""WITH {_R}, e AS (SELECT provider, question_id, count(*) AS judged, count(*) FILTER (WHERE score >= 0.6) AS supported FROM r WHERE question_id IS NOT NULL GROUP BY ALL),
      a AS (SELECT provider, count(*) AS questions, CAST(sum(judged) AS BIGINT) AS judged, CAST(sum(supported) AS BIGINT) AS supported, round(avg(round(supported / judged, 4)), 4) AS macro FROM e GROUP BY provider),
      w AS (SELECT *, supported / judged AS p, 1.96 * 1.96 AS zz FROM a)
      SELECT provider, questions, judged, supported, macro, round(p, 4) AS micro,
        round(greatest(0.0, (p + zz / (2 * judged)) / (1 + zz / judged) - 1.96 * sqrt(p * (1 - p) / judged + zz / (4.0 * judged * judged)) / (1 + zz / judged)), 3) AS low,
        round(least(1.0, (p + zz / (2 * judged)) / (1 + zz / judged) + 1.96 * sqrt(p * (1 - p) / judged + zz / (4.0 * judged * judged)) / (1 + zz / judged)), 3) AS high FROM w""",
    "matched_pair": f"""WITH {_R}, e AS (SELECT question_id, count(*) FILTER (WHERE provider = 'webscout') AS na, count(*) FILTER (WHERE provider = 'newsgrid') AS nb,
        count(*) FILTER (WHERE provider = 'webscout' AND score >= 0.6) AS sa, count(*) FILTER (WHERE provider = 'newsgrid' AND score >= 0.6) AS sb FROM r WHERE question_id IS NOT NULL AND provider IN ('webscout', 'newsgrid') GROUP BY question_id),
      m AS (SELECT count(*) FILTER (WHERE na > 0 AND nb > 0) AS matched, count(*) FILTER (WHERE NOT (na > 0 AND nb > 0)) AS excluded,
        round(avg(round(sa / na, 4)) FILTER (WHERE na > 0 AND nb > 0), 4) AS macro_a, round(avg(round(sb / nb, 4)) FILTER (WHERE na > 0 AND nb > 0), 4) AS macro_b,
        round(sum(sa) FILTER (WHERE na > 0 AND nb > 0) / sum(na) FILTER (WHERE na > 0 AND nb > 0), 4) AS micro_a, round(sum(sb) FILTER (WHERE na > 0 AND nb > 0) / sum(nb) FILTER (WHERE na > 0 AND nb > 0), 4) AS micro_b FROM e)
      SELECT *, round(macro_a - macro_b, 4) AS difference, CASE WHEN macro_a > macro_b THEN 'better' WHEN macro_a < macro_b THEN 'worse' ELSE 'equal' END AS direction FROM m""",
    "classifier_report": """WITH q AS (SELECT regexp_extract(question_id, '^[a-z]+-(.+)-\\d+$', 1) AS said, category FROM question_items WHERE category IS NOT NULL),
      u AS (SELECT said AS label, 1 AS p, 0 AS a, CAST(said = category AS INTEGER) AS t FROM q UNION ALL SELECT category, 0, 1, 0 FROM q),
      g AS (SELECT label, CAST(sum(t) AS BIGINT) AS tp, CAST(sum(p) AS BIGINT) AS predicted, CAST(sum(a) AS BIGINT) AS actual FROM u GROUP BY label)
      SELECT *, round(tp / nullif(predicted, 0), 4) AS precision, round(tp / nullif(actual, 0), 4) AS recall FROM g""",
    "depth_pivot": """SELECT source.provider AS provider, count(*) FILTER (WHERE depth = 'metadata') AS metadata, count(*) FILTER (WHERE depth = 'snippet') AS snippet, count(*) FILTER (WHERE depth = 'abstract') AS abstract, count(*) FILTER (WHERE depth = 'full_text') AS full_text FROM pool_chunks GROUP BY 1""",
}
