"""Changes of meaning between wordings, groups of sentences, outcomes and paired scores.

Bindings: a chunk and the next of its document are two wordings; two hundred and the
value under `k` of an event's props stand for a request's status; a document's arm is
its depth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import metrics as M
from corpusloom.operators import changes, facets
from corpusloom.operators import verdicts as V
from corpusloom.sources.tables import table


def _wordings(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "pool_chunks").filter("document_id is not null and position is not null and text is not null").groupBy("document_id", "position").agg(F.min("text").alias("text"))
    return c.withColumnRenamed("text", "before").join(c.select("document_id", (F.col("position") - 1).alias("position"), F.col("text").alias("after")), ["document_id", "position"])


def meaning_changes(s: SparkSession, d: str) -> DataFrame:
    """Pairs of wordings by the kinds of change between them."""
    w = _wordings(s, d).select(F.array_join(changes.meaning_changes(F.col("before"), F.col("after")), ",").alias("changes"))
    return w.groupBy("changes").agg(F.count("*").alias("pairs"))


def narrowed(s: SparkSession, d: str) -> DataFrame:
    """Per position, pairs whose later wording only tightens the earlier."""
    return _wordings(s, d).groupBy("position").agg(F.count("*").alias("pairs"), F.count_if(changes.is_narrowing(F.col("before"), F.col("after"))).alias("narrowed"))


def request_classes(s: SparkSession, d: str) -> DataFrame:
    """Events by the class of their status."""
    status = F.lit(200) + F.get_json_object("props", "$.k").cast("int") * 5
    return table(s, d, "events").groupBy("event_type", changes.error_class(status).alias("class")).agg(F.count("*").alias("events"))


def sentence_groups(s: SparkSession, d: str) -> DataFrame:
    """Chunks that begin with the same sentence, grouped: the sentence's hash, rows and the sources that state it."""
    c = table(s, d, "pool_chunks").filter("text is not null").select("row_id", "source_fingerprint", F.regexp_extract("text", r"^([^.!?]*[.!?])", 1).alias("sentence")).filter("sentence <> ''")
    g = c.groupBy(F.sha2("sentence", 256).alias("sentence_hash")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("row_id")).cast("array<string>"), ",").alias("rows"), F.countDistinct("source_fingerprint").alias("sources"))
    return g.filter("n > 1")


def outcome_metrics(s: SparkSession, d: str) -> DataFrame:
    """Per category: questions, those whose pool came out, core coverage, share lost, and the reasons for loss as one text."""
    q = table(s, d, "question_items").filter("category is not null").groupBy("category", "question_id").agg(F.max(F.coalesce("premise_is_false", F.lit(False))).alias("core"))
    pools = table(s, d, "evidence_pools").select("question_id", F.lit(True).alias("pool")).distinct()
    chunks = table(s, d, "pool_chunks").filter("question_id is not null").groupBy("question_id").agg(F.count("*").alias("chunks"))
    j = q.join(pools, "question_id", "left").join(chunks, "question_id", "left")
    reason = F.when(F.col("pool").isNull(), "no_pool").when(F.col("chunks").isNull(), "no_chunks")
    j = j.withColumn("reason", reason)
    return j.groupBy("category").agg(
        F.count("*").alias("questions"), F.count_if(F.col("reason").isNull()).alias("kept"), M.rate(F.col("reason").isNull(), F.col("core")).alias("core_coverage"), M.rate(F.col("reason").isNotNull()).alias("loss"),
        F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"),
    )


def paired_scores(s: SparkSession, d: str) -> DataFrame:
    """Two providers on the same questions: mean share of supported chunks over the pairs, and with a missing one counted as nothing."""
    score = F.col("source.relevance_score")
    c = table(s, d, "pool_chunks").filter(F.col("question_id").isNotNull() & F.col("source.provider").isin("webscout", "newsgrid")).select("question_id", F.col("source.provider").alias("arm"), F.when(~F.isnan(score), score).alias("s"))
    each = c.groupBy("question_id").agg(*[F.avg(F.when((F.col("arm") == a) & F.col("s").isNotNull(), (F.col("s") >= 0.6).cast("double"))).alias(a) for a in ("webscout", "newsgrid")])
    both = F.col("webscout").isNotNull() & F.col("newsgrid").isNotNull()
    return each.agg(
        F.count_if(both).alias("pairs"), F.round(F.avg(F.when(both, F.col("webscout"))), 4).alias("a"), F.round(F.avg(F.when(both, F.col("newsgrid"))), 4).alias("b"),
        F.round(F.avg(F.coalesce("webscout", F.lit(0.0))), 4).alias("a_missing_as_none"), F.round(F.avg(F.coalesce("newsgrid", F.lit(0.0))), 4).alias("b_missing_as_none"),
    )


def fates(s: SparkSession, d: str) -> DataFrame:
    """What became of each source: cited in a full text, contested, listed, recorded, or unaccounted; the best place it has."""
    score = F.col("source.relevance_score")
    place = F.when((F.col("depth") == "full_text") & (score >= 0.6), "body").when(score < 0.2, "contested").when(F.col("source.rank").isNotNull(), "listed").otherwise("recorded")
    c = table(s, d, "pool_chunks").filter("source_fingerprint is not null").select(F.col("source_fingerprint").alias("fingerprint"), place.alias("place"))
    order = F.array(*[F.lit(x) for x in ("body", "contested", "listed", "recorded")])
    best = c.groupBy("fingerprint").agg(F.min_by("place", F.array_position(order, F.col("place"))).alias("fate"))
    every = table(s, d, "paper_records").select("fingerprint", F.lit("paper").alias("kind")).union(table(s, d, "web_results").select("fingerprint", F.lit("page"))).filter("fingerprint is not null").distinct()
    return every.join(best, "fingerprint", "left").groupBy("kind", F.coalesce("fate", F.lit("unaccounted")).alias("fate")).agg(F.count("*").alias("sources"))


def document_checks(s: SparkSession, d: str) -> DataFrame:
    """One pass of named checks over documents: how many fail each; a document fails a check or not, whatever else it fails."""
    t = table(s, d, "documents")
    known = table(s, d, "question_items").select("question_id").distinct().withColumn("known", F.lit(True))
    j = t.select("doc_id", "text", "title", "question_id", "depth", "n_chars", "lang").join(known, "question_id", "left")
    text = F.coalesce("text", F.lit(""))
    fails = {
        "question_unknown": F.col("question_id").isNotNull() & F.col("known").isNull(), "text_empty": F.trim(text) == "", "length_wrong": F.length(text) != F.coalesce("n_chars", F.lit(-1)), "title_missing": F.col("title").isNull(),
        "language_missing": F.col("lang").isNull(), "contradicts_itself": (F.size(facets.values(text, facets.BASELINE)) > 1), "only_metadata_but_long": (F.col("depth") == "metadata") & (F.length(text) > 1000),
    }
    return j.select(F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in fails.items()]))).alias("check")).groupBy("check").agg(F.count("*").alias("documents"))


def verdict_agreement(s: SparkSession, d: str) -> DataFrame:
    """Chunks whose verdict by score is among those acceptable for their depth, per depth."""
    score = F.col("source.relevance_score")
    verdict = F.when(score >= 0.6, "supported").when(score < 0.2, "contradicted").otherwise("not_enough_evidence")
    acceptable = F.when(F.col("depth") == "full_text", F.array(F.lit("supported"), F.lit("not_enough_evidence")))
    c = table(s, d, "pool_chunks").filter(score.isNotNull() & ~F.isnan(score))
    return c.groupBy("depth").agg(F.count("*").alias("judged"), M.rate(V.agreed(verdict, F.lit("supported"), acceptable)).alias("agreement"))


QUERIES = {f.__name__: f for f in (meaning_changes, narrowed, request_classes, sentence_groups, outcome_metrics, paired_scores, fates, document_checks, verdict_agreement)}


def _all(text: str, pattern: str) -> str:
    return f"list_sort(list_distinct(regexp_extract_all(lower({text}), '{pattern}', 1)))"


_W = "c AS (SELECT document_id, position, min(text) AS text FROM pool_chunks WHERE document_id IS NOT NULL AND position IS NOT NULL AND text IS NOT NULL GROUP BY ALL), w AS (SELECT a.position, a.text AS x, b.text AS y FROM c a JOIN c b ON a.document_id = b.document_id AND b.position = a.position + 1)"
_N = {p: (_all("x", v), _all("y", v)) for p, v in (("number", changes.NUMBERS), ("negation", changes.NEGATIONS), ("hedge", changes.HEDGES), ("scope", facets.SCOPE))}
_LOST = {p: f"len(list_filter({a}, lambda v: NOT list_contains({b}, v)))" for p, (a, b) in _N.items()}
_GAIN = {p: f"len(list_filter({b}, lambda v: NOT list_contains({a}, v)))" for p, (a, b) in _N.items()}

ORACLE = {
    "meaning_changes": f"""WITH {_W} SELECT concat_ws(',', CASE WHEN {_N['number'][0]} <> {_N['number'][1]} THEN 'number' END, CASE WHEN len({_N['negation'][0]}) <> len({_N['negation'][1]}) THEN 'negation' END, CASE WHEN {_LOST['hedge']} > 0 THEN 'qualification' END,
      CASE WHEN len({_N['scope'][0]}) > 0 AND len({_N['scope'][1]}) > 0 AND {_N['scope'][0]} <> {_N['scope'][1]} THEN 'scope' END) AS changes, count(*) AS pairs FROM w GROUP BY 1""",
    "narrowed": f"WITH {_W} SELECT position, count(*) AS pairs, count(*) FILTER (WHERE {_LOST['number']} = 0 AND {_LOST['negation']} = 0 AND {_LOST['hedge']} = 0 AND ({_GAIN['number']} > 0 OR {_GAIN['hedge']} > 0)) AS narrowed FROM w GROUP BY 1",
    "request_classes": """WITH e AS (SELECT event_type, 200 + CAST(json_extract_string(props, '$.k') AS INTEGER) * 5 AS s FROM events) SELECT event_type, CASE WHEN s BETWEEN 200 AND 299 THEN 'ok' WHEN s = 429 THEN 'rate_limited' WHEN s BETWEEN 400 AND 499 THEN 'rejected' WHEN s >= 500 THEN 'unavailable' ELSE 'unknown' END AS class, count(*) AS events FROM e GROUP BY ALL""",
    "sentence_groups": """WITH c AS (SELECT row_id, source_fingerprint, regexp_extract(text, '^([^.!?]*[.!?])', 1) AS s FROM pool_chunks WHERE text IS NOT NULL) SELECT sha256(s) AS sentence_hash, count(*) AS n, string_agg(CAST(row_id AS VARCHAR), ',' ORDER BY row_id) AS rows, count(DISTINCT source_fingerprint) AS sources FROM c WHERE s <> '' GROUP BY 1 HAVING count(*) > 1""",
    "outcome_metrics": """WITH q AS (SELECT category, question_id, bool_or(coalesce(premise_is_false, false)) AS core FROM question_items WHERE category IS NOT NULL GROUP BY ALL), p AS (SELECT DISTINCT question_id, true AS pool FROM evidence_pools), c AS (SELECT question_id, count(*) AS chunks FROM pool_chunks WHERE question_id IS NOT NULL GROUP BY 1),
      j AS (SELECT *, CASE WHEN pool IS NULL THEN 'no_pool' WHEN chunks IS NULL THEN 'no_chunks' END AS reason FROM q LEFT JOIN p USING (question_id) LEFT JOIN c USING (question_id))
      SELECT category, count(*) AS questions, count(*) FILTER (WHERE reason IS NULL) AS kept, round(count(*) FILTER (WHERE reason IS NULL AND core) / nullif(count(*) FILTER (WHERE core), 0), 4) AS core_coverage, round(count(reason) / count(*), 4) AS loss, coalesce(string_agg(DISTINCT reason, ',' ORDER BY reason), '') AS reasons FROM j GROUP BY 1""",
    "paired_scores": """WITH c AS (SELECT question_id, source.provider AS arm, CASE WHEN NOT isnan(source.relevance_score) THEN source.relevance_score END AS s FROM pool_chunks WHERE question_id IS NOT NULL AND source.provider IN ('webscout', 'newsgrid')),
      e AS (SELECT question_id, avg(CASE WHEN s >= 0.6 THEN 1.0 WHEN s IS NOT NULL THEN 0.0 END) FILTER (WHERE arm = 'webscout') AS a, avg(CASE WHEN s >= 0.6 THEN 1.0 WHEN s IS NOT NULL THEN 0.0 END) FILTER (WHERE arm = 'newsgrid') AS b FROM c GROUP BY 1)
      SELECT count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS pairs, round(avg(a) FILTER (WHERE b IS NOT NULL), 4) AS a, round(avg(b) FILTER (WHERE a IS NOT NULL), 4) AS b, round(avg(coalesce(a, 0)), 4) AS a_missing_as_none, round(avg(coalesce(b, 0)), 4) AS b_missing_as_none FROM e""",
    "fates": """WITH c AS (SELECT source_fingerprint AS fingerprint, CASE WHEN depth = 'full_text' AND NOT isnan(source.relevance_score) AND source.relevance_score >= 0.6 OR depth = 'full_text' AND isnan(source.relevance_score) THEN 1 WHEN NOT isnan(source.relevance_score) AND source.relevance_score < 0.2 THEN 2 WHEN source.rank IS NOT NULL THEN 3 ELSE 4 END AS p FROM pool_chunks WHERE source_fingerprint IS NOT NULL),
      b AS (SELECT fingerprint, min(p) AS p FROM c GROUP BY 1), k AS (SELECT DISTINCT fingerprint, kind FROM (SELECT fingerprint, 'paper' AS kind FROM paper_records UNION ALL SELECT fingerprint, 'page' FROM web_results) WHERE fingerprint IS NOT NULL)
      SELECT kind, coalesce(['body', 'contested', 'listed', 'recorded'][p], 'unaccounted') AS fate, count(*) AS sources FROM k LEFT JOIN b USING (fingerprint) GROUP BY ALL""",
    "document_checks": f"""WITH k AS (SELECT DISTINCT question_id, true AS known FROM question_items), j AS (SELECT d.*, known, coalesce(text, '') AS t FROM documents d LEFT JOIN k USING (question_id)),
      f AS (SELECT unnest(list_filter([CASE WHEN question_id IS NOT NULL AND known IS NULL THEN 'question_unknown' END, CASE WHEN trim(t) = '' THEN 'text_empty' END, CASE WHEN length(t) <> coalesce(n_chars, -1) THEN 'length_wrong' END, CASE WHEN title IS NULL THEN 'title_missing' END,
        CASE WHEN lang IS NULL THEN 'language_missing' END, CASE WHEN len({_all('t', facets.BASELINE)}) > 1 THEN 'contradicts_itself' END, CASE WHEN depth = 'metadata' AND length(t) > 1000 THEN 'only_metadata_but_long' END], lambda x: x IS NOT NULL)) AS "check" FROM j) SELECT "check", count(*) AS documents FROM f GROUP BY 1""",
    "verdict_agreement": """WITH c AS (SELECT depth, CASE WHEN source.relevance_score >= 0.6 THEN 'supported' WHEN source.relevance_score < 0.2 THEN 'contradicted' ELSE 'not_enough_evidence' END AS v FROM pool_chunks WHERE source.relevance_score IS NOT NULL AND NOT isnan(source.relevance_score))
      SELECT depth, count(*) AS judged, round(count(*) FILTER (WHERE v = 'supported' OR (depth = 'full_text' AND v = 'not_enough_evidence')) / count(*), 4) AS agreement FROM c GROUP BY 1""",
}
