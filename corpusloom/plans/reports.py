"""Reports over evidence: alignment, validity, priorities, status, nested and rendered results.

Bindings: a pool is a report, a question's chunks its claims, sources its
citations; a chunk supports from a relevance of 0.6, contradicts below 0.2.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import metrics as M
from corpusloom.functions import text as X
from corpusloom.operators import evidence as V
from corpusloom.sources.tables import table


def _scored(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "pool_chunks").select("question_id", "document_id", "row_id", "source_fingerprint", F.col("source.provider").alias("provider"), F.col("source.relevance_score").alias("score"), F.col("source.retrieved_at").alias("retrieved_at"))
    return c.filter(F.col("question_id").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))


def best_outcome(s: SparkSession, d: str) -> DataFrame:
    """Per question and source, the best outcome of its chunks: supports, then none, then contradicts."""
    out = F.when(F.col("score") >= 0.6, "supports").when(F.col("score") < 0.2, "contradicts").otherwise("none")
    return _scored(s, d).withColumn("outcome", out).groupBy("question_id", "source_fingerprint").agg(V.best_by(["supports", "none", "contradicts"], F.col("outcome")).alias("outcome"))


def citation_validity(s: SparkSession, d: str) -> DataFrame:
    """Cited sources of each question: valid with a supporting chunk, misattributed without, fabricated without a fingerprint."""
    c = table(s, d, "pool_chunks").filter("question_id is not null").select("question_id", "source_fingerprint").distinct()
    e = _scored(s, d).filter("score >= 0.6").select("question_id", "source_fingerprint", "row_id")
    return V.validated(c, e, "question_id", "source_fingerprint", "row_id", "row_id").groupBy("status").agg(F.count("*").alias("citations"), F.count("supporting").alias("supported"))


def claim_priority(s: SparkSession, d: str) -> DataFrame:
    """Chunks of each question by score, and how many of them and of their score fall within a cap of 10."""
    r = V.prioritised(_scored(s, d), "question_id", [F.desc("score"), F.col("row_id")], 10)
    return r.groupBy("question_id").agg(F.count_if("evaluated").alias("evaluated"), F.count_if(~F.col("evaluated")).alias("beyond_cap"), F.round(F.min(F.when(F.col("evaluated"), F.col("score"))), 6).alias("least_score"))


def question_status(s: SparkSession, d: str) -> DataFrame:
    """Every question's status from its chunks: gap, contested, well or mixed."""
    q = table(s, d, "question_items").select("question_id").distinct()
    c = _scored(s, d).groupBy("question_id").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= 0.6).alias("good"), F.count_if(F.col("score") < 0.2).alias("bad"))
    j = q.join(c, "question_id", "left").fillna(0, ["n", "good", "bad"])
    return j.select("question_id", V.coverage_status(F.col("n"), F.col("good"), F.col("bad")).alias("status"))


def label_alignment(s: SparkSession, d: str) -> DataFrame:
    """Pages whose words are all in a paper's title, by their longest common first word: how many align."""
    p = table(s, d, "paper_records").select(F.lit(1).alias("g"), "paper_key", F.array_distinct(F.filter(F.split(F.lower("title"), r"[^a-z0-9]+"), lambda w: F.length(w) > 7)).alias("markers"))
    w = table(s, d, "web_results").select(F.lit(1).alias("g"), "web_key", F.array_distinct(F.filter(F.split(F.lower("title"), r"[^a-z0-9]+"), lambda w: F.length(w) > 7)).alias("labels"))
    found = V.aligned(w.filter("size(labels) > 2").distinct(), p.distinct(), "g", "web_key", "paper_key", 10)
    return found.select("web_key", "paper_key", F.col("fit").cast("long").alias("fit"))


def nested_trace(s: SparkSession, d: str) -> DataFrame:
    """Per question its three best chunks nested in order, as one JSON text."""
    r = V.prioritised(_scored(s, d), "question_id", [F.desc("score"), F.col("row_id")], 3).filter("evaluated")
    listed = F.array_sort(F.collect_list(F.struct("rank", "row_id")))
    return r.groupBy("question_id").agg(F.array_join(F.transform(listed, lambda x: x["row_id"].cast("string")), ",").alias("chunks"))


def reference_lines(s: SparkSession, d: str) -> DataFrame:
    """Per question, its providers as one sorted line with the number of chunks of each."""
    c = table(s, d, "pool_chunks").filter("question_id is not null").groupBy("question_id", F.col("source.provider").alias("provider")).agg(F.count("*").alias("n"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("provider", "n"))), lambda x: F.concat(x["provider"], F.lit(" ("), x["n"].cast("string"), F.lit(")"))), "; ")
    return c.filter("provider is not null").groupBy("question_id").agg(line.alias("providers"))


def retrieval_span(s: SparkSession, d: str) -> DataFrame:
    """Per question, seconds from the first to the last retrieval."""
    r = _scored(s, d).filter("retrieved_at is not null").groupBy("question_id").agg(F.min("retrieved_at").alias("a"), F.max("retrieved_at").alias("b"))
    return r.select("question_id", ((F.unix_micros(F.col("b").cast("timestamp")) - F.unix_micros(F.col("a").cast("timestamp"))) / 1e6).alias("seconds"))


def ratio_terms(s: SparkSession, d: str) -> DataFrame:
    """Per provider the supported share as value and as its terms, "n/d"."""
    r = _scored(s, d).groupBy("provider").agg(F.count_if(F.col("score") >= 0.6).alias("n"), F.count("*").alias("d"))
    return r.select("provider", M.ratio(F.col("n"), F.col("d")).alias("value"), F.concat_ws("/", F.col("n").cast("string"), F.col("d").cast("string")).alias("terms"))


def blinded_items(s: SparkSession, d: str) -> DataFrame:
    """Distinct question texts in an order drawn from a seed, without their sets: the first of each and how often it stands."""
    q = table(s, d, "question_items").filter("question is not null").select(F.sha2("question", 256).alias("item"), "question_id")
    return q.groupBy("item").agg(F.count("*").alias("copies"), F.min("question_id").alias("first_id")).withColumn("order_key", F.sha2(F.concat(F.lit("17:"), "item"), 256))


def document_titles(s: SparkSession, d: str) -> DataFrame:
    """The first `## ` heading of a document, else its title, else a default."""
    t = table(s, d, "documents")
    return t.select("doc_id", F.coalesce(F.nullif(F.trim(F.regexp_extract("text", r"(?m)^## (.*)$", 1)), F.lit("")), "title", F.lit("Untitled")).alias("heading"))


def token_estimates(s: SparkSession, d: str) -> DataFrame:
    """Per language: texts, estimated tokens and the upper bound in bytes."""
    t = table(s, d, "documents")
    return t.groupBy(F.coalesce("lang", F.lit("unknown")).alias("lang")).agg(
        F.count("*").alias("texts"), F.sum(X.estimated_tokens(F.col("text"))).alias("tokens"), F.sum(F.coalesce(X.token_bound(F.col("text"), F.lit("")), F.lit(0)).cast("long")).alias("bound")
    )


QUERIES = {
    f.__name__: f
    for f in (best_outcome, citation_validity, claim_priority, question_status, label_alignment, nested_trace, reference_lines, retrieval_span, ratio_terms, blinded_items, document_titles, token_estimates)
}

_S = """s AS (SELECT question_id, row_id, source_fingerprint, source.provider AS provider, source.relevance_score AS score, source.retrieved_at AS retrieved_at FROM pool_chunks
  WHERE question_id IS NOT NULL AND source.relevance_score IS NOT NULL AND NOT isnan(source.relevance_score))"""
_N = "n AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, row_id) - 1 AS rank FROM s)"
_WORDS = "list_distinct(list_filter(string_split_regex(lower(title), '[^a-z0-9]+'), lambda w: length(w) > 7))"

ORACLE = {
    "best_outcome": f"""WITH {_S} SELECT question_id, source_fingerprint, CASE WHEN count(*) FILTER (WHERE score >= 0.6) > 0 THEN 'supports' WHEN count(*) FILTER (WHERE score < 0.6 AND score >= 0.2) > 0 THEN 'none' ELSE 'contradicts' END AS outcome FROM s GROUP BY 1, 2""",
    "citation_validity": f"""WITH {_S}, e AS (SELECT question_id, source_fingerprint, min(row_id) AS supporting FROM s WHERE score >= 0.6 GROUP BY 1, 2), c AS (SELECT DISTINCT question_id, source_fingerprint FROM pool_chunks WHERE question_id IS NOT NULL)
      SELECT CASE WHEN c.source_fingerprint IS NULL THEN 'fabricated' WHEN supporting IS NULL THEN 'misattributed' ELSE 'valid' END AS status, count(*) AS citations, count(supporting) AS supported FROM c LEFT JOIN e USING (question_id, source_fingerprint) GROUP BY 1""",
    "claim_priority": f"WITH {_S}, {_N} SELECT question_id, count(*) FILTER (WHERE rank < 10) AS evaluated, count(*) FILTER (WHERE rank >= 10) AS beyond_cap, round(min(score) FILTER (WHERE rank < 10), 6) AS least_score FROM n GROUP BY 1",
    "question_status": f"""WITH {_S}, c AS (SELECT question_id, count(*) AS n, count(*) FILTER (WHERE score >= 0.6) AS good, count(*) FILTER (WHERE score < 0.2) AS bad FROM s GROUP BY 1)
      SELECT question_id, CASE WHEN coalesce(n, 0) = 0 THEN 'gap' WHEN bad > 0 THEN 'contested' WHEN good * 2 >= n THEN 'well' ELSE 'mixed' END AS status FROM (SELECT DISTINCT question_id FROM question_items) LEFT JOIN c USING (question_id)""",
    "label_alignment": f"""WITH p AS (SELECT DISTINCT paper_key, {_WORDS} AS markers FROM paper_records), w AS (SELECT DISTINCT web_key, {_WORDS} AS labels FROM web_results),
      j AS (SELECT web_key, paper_key, (len(labels) * 100) // len(markers) AS fit FROM w JOIN p ON list_has_all(markers, labels) WHERE len(labels) > 2),
      r AS (SELECT *, row_number() OVER o AS n, lead(fit) OVER o AS next FROM j WINDOW o AS (PARTITION BY web_key ORDER BY fit DESC, paper_key))
      SELECT web_key, paper_key, fit FROM r WHERE n = 1 AND (next IS NULL OR fit - next >= 10)""",
    "nested_trace": f"WITH {_S}, {_N} SELECT question_id, string_agg(CAST(row_id AS VARCHAR), ',' ORDER BY rank) AS chunks FROM n WHERE rank < 3 GROUP BY 1",
    "reference_lines": """WITH c AS (SELECT question_id, source.provider AS provider, count(*) AS n FROM pool_chunks WHERE question_id IS NOT NULL GROUP BY ALL) SELECT question_id, string_agg(provider || ' (' || n || ')', '; ' ORDER BY provider) AS providers FROM c WHERE provider IS NOT NULL GROUP BY 1""",
    "retrieval_span": f"WITH {_S} SELECT question_id, (epoch_us(max(retrieved_at)) - epoch_us(min(retrieved_at))) / 1e6 AS seconds FROM s WHERE retrieved_at IS NOT NULL GROUP BY 1",
    "ratio_terms": f"WITH {_S}, r AS (SELECT provider, count(*) FILTER (WHERE score >= 0.6) AS n, count(*) AS d FROM s GROUP BY 1) SELECT provider, round(n / d, 4) AS value, n || '/' || d AS terms FROM r",
    "blinded_items": "WITH q AS (SELECT sha256(question) AS item, count(*) AS copies, min(question_id) AS first_id FROM question_items WHERE question IS NOT NULL GROUP BY 1) SELECT *, sha256('17:' || item) AS order_key FROM q",
    "document_titles": "SELECT doc_id, coalesce(nullif(trim(regexp_extract(text, '(?m)^## (.*)$', 1)), ''), title, 'Untitled') AS heading FROM documents",
    "token_estimates": "SELECT coalesce(lang, 'unknown') AS lang, count(*) AS texts, CAST(sum(coalesce(length(text), 0) // 4) AS BIGINT) AS tokens, CAST(sum(coalesce(strlen(text) + 256, 0)) AS BIGINT) AS bound FROM documents GROUP BY 1",
}
