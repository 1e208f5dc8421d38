"""Joins, traces, sets, checks and accounts.

Bindings: a question is a claim, its pool the report, chunks are evidence, sources
papers and pages; events are a run's stages with their cost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import metrics as M
from corpusloom.functions import text as X
from corpusloom.operators import checks, dedup
from corpusloom.sources.tables import table


def pool_chunks_of_run(s: SparkSession, d: str) -> DataFrame:
    """Chunks with their pool and question, in document order."""
    c = table(s, d, "pool_chunks").select("question_id", "document_id", "position", "row_id", "depth")
    p = table(s, d, "evidence_pools").select("question_id", "pool_version").distinct()
    q = table(s, d, "question_items").filter("category is not null").groupBy("question_id").agg(F.min("category").alias("category"))
    return c.join(p, "question_id").join(q, "question_id").select("question_id", "category", "pool_version", "document_id", "position", "row_id", "depth")


def unverified_questions(s: SparkSession, d: str) -> DataFrame:
    """Questions without a pool."""
    q = table(s, d, "question_items").select("question_id", "set_name").distinct()
    return q.join(table(s, d, "evidence_pools").select("question_id"), "question_id", "left_anti")


def resolved_sources(s: SparkSession, d: str) -> DataFrame:
    """Per provider: chunks whose fingerprint resolves to a paper, to a page, or to nothing."""
    c = table(s, d, "pool_chunks").select("row_id", F.col("source.provider").alias("provider"), F.col("source_fingerprint").alias("fingerprint"))
    p = table(s, d, "paper_records").select("fingerprint").distinct().withColumn("paper", F.lit(1))
    w = table(s, d, "web_results").select("fingerprint").distinct().withColumn("page", F.lit(1))
    j = c.join(p, "fingerprint", "left").join(w, "fingerprint", "left")
    return j.groupBy("provider").agg(
        F.count("*").alias("chunks"), F.count("paper").alias("papers"), F.count_if(F.col("paper").isNull() & F.col("page").isNotNull()).alias("pages"),
        F.count_if(F.col("paper").isNull() & F.col("page").isNull()).alias("unresolved"),
    )


def question_trace(s: SparkSession, d: str) -> DataFrame:
    """Per question: its pools, chunks, documents and sources, each child aggregated before the join."""
    q = table(s, d, "question_items").select("question_id").distinct()
    p = table(s, d, "evidence_pools").groupBy("question_id").agg(F.count("*").alias("pools"))
    c = table(s, d, "pool_chunks").groupBy("question_id").agg(F.count("*").alias("chunks"), F.countDistinct("document_id").alias("documents"), F.countDistinct("source_fingerprint").alias("sources"))
    return q.join(p, "question_id", "left").join(c, "question_id", "left").fillna(0, ["pools", "chunks", "documents", "sources"])


def found_by(s: SparkSession, d: str) -> DataFrame:
    """Per fingerprint, the queries that found a page, in order of first appearance, as one text."""
    w = table(s, d, "web_results").select("fingerprint", "query", "web_key").filter("query is not null")
    return dedup.found_by(w, "fingerprint", "query", "web_key").select("fingerprint", F.size("finders").alias("queries"), F.array_join("finders", " || ").alias("found_by"))


def label_update(s: SparkSession, d: str) -> DataFrame:
    """Questions per origin after labels of the bank are written where the set is held out."""
    q = table(s, d, "question_items").select("question_id", "set_name", "origin")
    new = q.filter("set_name <> 'development'").select("question_id").distinct().withColumn("label", F.lit("held_out"))
    return q.join(new, "question_id", "left").select(F.coalesce("label", "origin", F.lit("unknown")).alias("origin")).groupBy("origin").agg(F.count("*").alias("items"))


def set_operations(s: SparkSession, d: str) -> DataFrame:
    """Questions with chunks from both search channels, from either, and from one only."""
    c = table(s, d, "pool_chunks").filter("question_id is not null").select("question_id", F.col("source.source_type").alias("kind"))
    kinds = c.groupBy("question_id").agg(F.countDistinct("kind").alias("n"), F.min("kind").alias("least"))
    return kinds.groupBy(F.when(F.col("n") > 1, "both").otherwise(F.concat(F.lit("only "), "least")).alias("channels")).agg(F.count("*").alias("questions"))


def exact_text_dedup(s: SparkSession, d: str) -> DataFrame:
    """Texts that stand under several ids: hash, copies and the least id."""
    t = table(s, d, "documents").filter("text is not null and text <> ''").select(F.sha2("text", 256).alias("content_hash"), "doc_id")
    return t.groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("kept")).filter("copies > 1")


def chunk_constraints(s: SparkSession, d: str) -> DataFrame:
    """Rules of chunks that rows break, and how many break each."""
    c = table(s, d, "pool_chunks")
    rules = {
        "span_is_positive": F.col("end_char") > F.col("start_char"),
        "span_fits_text": F.col("end_char") - F.col("start_char") == F.length("text"),
        "hash_fits_text": F.sha2("text", 256) == F.col("content_hash"),
        "fingerprints_agree": F.col("source_fingerprint") == F.col("source.fingerprint"),
        "year_is_plausible": F.col("source.year").between(1401, 2199),
        "citations_not_negative": F.col("source.citation_count") >= 0,
        "score_within_one": F.isnan("source.relevance_score") | F.col("source.relevance_score").between(0, 1),
        "has_identifier": F.coalesce("source.doi", "source.url", "source.external_id").isNotNull(),
    }
    found = checks.breaking(c, rules, "row_id")
    found = found.unionByName(checks.repeated(c, ["chunk_id"], "chunk_id_is_unique")).unionByName(checks.dangling(c, "question_id", table(s, d, "question_items"), "question_id", "question_exists"))
    return found.groupBy("rule").agg(F.count("*").alias("broken"))


def item_constraints(s: SparkSession, d: str) -> DataFrame:
    """Question ids that are repeated, or lack their set's prefix."""
    q = table(s, d, "question_items")
    prefix = F.when(F.col("set_name") == "development", "dev-").when(F.col("set_name") == "validation", "val-").when(F.col("set_name") == "test", "tst-")
    bad = checks.breaking(q, {"id_has_prefix": F.startswith("question_id", prefix), "category_is_known": F.col("category").isNotNull()}, "question_id")
    return bad.unionByName(checks.repeated(q, ["question_id"], "id_is_unique")).groupBy("rule", "key").agg(F.count("*").alias("rows"))


def status_transitions(s: SparkSession, d: str) -> DataFrame:
    """Events that may not follow the user's event before (purchase without a click, say), per pair."""
    e = table(s, d, "events").select("user_id", "ts", "event_id", "event_type")
    allowed = [(None, "view"), (None, "signup"), ("signup", "view"), ("view", "view"), ("view", "click"), ("click", "view"), ("click", "purchase"), ("click", "click"), ("purchase", "view")]
    bad = checks.transitions(e, "user_id", ["ts", "event_id"], "event_type", allowed)
    return bad.groupBy(F.coalesce("before", F.lit("(start)")).alias("before"), "event_type").agg(F.count("*").alias("events"))


def stage_totals(s: SparkSession, d: str) -> DataFrame:
    """Per event type: events, users, total and mean value; with a grand total."""
    e = table(s, d, "events")
    total = e.groupBy("event_type").agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"), F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 4).alias("total"))
    whole = e.agg(F.lit("(all)").alias("event_type"), F.count("*").alias("events"), F.countDistinct("user_id").alias("users"), F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 4).alias("total"))
    return total.unionByName(whole)


def metric_rows(s: SparkSession, d: str) -> DataFrame:
    """Wide figures of each provider as long rows (metric, value); unknown ones left out."""
    c = table(s, d, "pool_chunks").select(F.col("source.provider").alias("provider"), F.col("source.relevance_score").alias("score"), F.col("source.rank").alias("rank"), "text")
    wide = c.groupBy("provider").agg(
        F.count("*").cast("double").alias("chunks"), F.count("rank").cast("double").alias("ranked"), F.max("rank").cast("double").alias("deepest"), F.sum(F.length("text")).cast("double").alias("characters")
    )
    return wide.unpivot(["provider"], ["chunks", "ranked", "deepest", "characters"], "metric", "value").filter("value is not null")


def token_costs(s: SparkSession, d: str) -> DataFrame:
    """Per depth: estimated tokens and their cost at the price of the longest matching prefix; no price, no cost."""
    prices = s.createDataFrame([("a", 1.0), ("abs", 2.0), ("full", 3.0)], "prefix string, price double")
    t = table(s, d, "documents").groupBy("depth").agg(F.sum(X.estimated_tokens(F.col("text"))).alias("tokens"))
    best = t.join(F.broadcast(prices), F.startswith("depth", "prefix"), "left").groupBy("depth", "tokens").agg(F.max_by("price", F.length("prefix")).alias("price"))
    return best.select("depth", "tokens", F.round(F.col("tokens") * F.col("price"), 6).alias("cost"))


def budget_fold(s: SparkSession, d: str) -> DataFrame:
    """Events admitted while each user's spending stays within 100, refused ones costing nothing: an ordered fold."""
    e = table(s, d, "events").select("user_id", "ts", "event_id", "value")

    def step(spent: float, r: dict):
        cost = r["value"] or 0.0
        if spent + cost > 100:
            return spent, (r["user_id"], r["event_id"], False, spent)
        return spent + cost, (r["user_id"], r["event_id"], True, spent + cost)

    folded = dedup.ordered_fold(e, "user_id", ["ts", "event_id"], step, float, "user_id long, event_id long, admitted boolean, spent double")
    return folded.groupBy("user_id").agg(F.count_if("admitted").alias("admitted"), F.count_if(~F.col("admitted")).alias("refused"), F.round(F.max("spent"), 4).alias("spent"))


def duplicate_flags(s: SparkSession, d: str) -> DataFrame:
    """Chunks of a question whose text an earlier one of it has."""
    c = table(s, d, "pool_chunks").filter("question_id is not null").select("question_id", "content_hash", "row_id")
    first = c.groupBy("question_id", "content_hash").agg(F.min("row_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    return c.join(first, ["question_id", "content_hash"]).filter("row_id > first").select("row_id", "first")


def section_spans(s: SparkSession, d: str) -> DataFrame:
    """Sections of documents: the span from one `## ` heading to the next."""
    t = table(s, d, "documents").filter(F.contains("text", F.lit("## "))).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    w = Window.partitionBy("doc_id").orderBy("line_no")
    start = F.coalesce(F.sum(F.length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    size = F.sum(F.length("line") + 1).over(Window.partitionBy("doc_id")) - 1
    heads = t.select("doc_id", "line_no", "line", start.alias("start_char"), size.alias("size")).filter(F.startswith("line", F.lit("## ")))
    return heads.select("doc_id", F.substring("line", 4, 1000).alias("heading"), "start_char", F.coalesce(F.lead("start_char").over(w), F.col("size")).alias("end_char"))


def recent_pools(s: SparkSession, d: str) -> DataFrame:
    """The second page of ten of the newest pools."""
    p = table(s, d, "evidence_pools").select("question_id", "pool_version", "created_at").distinct()
    return p.orderBy(F.desc("created_at"), "question_id", "pool_version").offset(10).limit(10).select("question_id", "pool_version")


def sampled_order(s: SparkSession, d: str) -> DataFrame:
    """The first 20 questions by a hash of their id: a stable sample."""
    q = table(s, d, "question_items").select("question_id").distinct()
    return q.orderBy(F.sha2("question_id", 256)).limit(20)


def supplier_revenue(s: SparkSession, d: str) -> DataFrame:
    """Revenue and rate of returned lines per region: a chain of inner joins on the star tables."""
    places = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    suppliers = table(s, d, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "r_name")
    j = table(s, d, "lineitem").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return j.groupBy("r_name").agg(F.count("*").alias("lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), M.rate(F.col("l_returnflag") == "R").alias("returned"))


def order_gaps(s: SparkSession, d: str) -> DataFrame:
    """Customers without an urgent order, per segment."""
    urgent = table(s, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    c = table(s, d, "customer").join(urgent, "c_custkey", "left_anti")
    return c.groupBy("c_mktsegment").agg(F.count("*").alias("customers"))


QUERIES = {
    f.__name__: f
    for f in (pool_chunks_of_run, unverified_questions, resolved_sources, question_trace, found_by, label_update, set_operations, exact_text_dedup, chunk_constraints, item_constraints, status_transitions, stage_totals, metric_rows, token_costs, budget_fold, duplicate_flags, section_spans, recent_pools, sampled_order, supplier_revenue, order_gaps)
}

ORACLE = {
    "pool_chunks_of_run": """SELECT c.question_id, q.category, p.pool_version, c.document_id, c.position, c.row_id, c.depth FROM pool_chunks c JOIN (SELECT DISTINCT question_id, pool_version FROM evidence_pools) p USING (question_id)
      JOIN (SELECT question_id, min(category) AS category FROM question_items WHERE category IS NOT NULL GROUP BY 1) q USING (question_id)""",
    "unverified_questions": "SELECT DISTINCT question_id, set_name FROM question_items WHERE question_id NOT IN (SELECT question_id FROM evidence_pools WHERE question_id IS NOT NULL)",
    "resolved_sources": """WITH j AS (SELECT c.source.provider AS provider, p.fingerprint AS paper, w.fingerprint AS page FROM pool_chunks c LEFT JOIN (SELECT DISTINCT fingerprint FROM paper_records) p ON c.source_fingerprint = p.fingerprint LEFT JOIN (SELECT DISTINCT fingerprint FROM web_results) w ON c.source_fingerprint = w.fingerprint)
      SELECT provider, count(*) AS chunks, count(paper) AS papers, count(*) FILTER (WHERE paper IS NULL AND page IS NOT NULL) AS pages, count(*) FILTER (WHERE paper IS NULL AND page IS NULL) AS unresolved FROM j GROUP BY provider""",
    "question_trace": """SELECT q.question_id, coalesce(pools, 0) AS pools, coalesce(chunks, 0) AS chunks, coalesce(documents, 0) AS documents, coalesce(sources, 0) AS sources FROM (SELECT DISTINCT question_id FROM question_items) q
      LEFT JOIN (SELECT question_id, count(*) AS pools FROM evidence_pools GROUP BY 1) p USING (question_id) LEFT JOIN (SELECT question_id, count(*) AS chunks, count(DISTINCT document_id) AS documents, count(DISTINCT source_fingerprint) AS sources FROM pool_chunks GROUP BY 1) c USING (question_id)""",
    "found_by": """WITH f AS (SELECT fingerprint, query, min(web_key) AS k FROM web_results WHERE query IS NOT NULL GROUP BY 1, 2)
      SELECT fingerprint, CAST(count(*) AS INTEGER) AS queries, string_agg(query, ' || ' ORDER BY k, query) AS found_by FROM f GROUP BY fingerprint""",
    "label_update": """SELECT coalesce(CASE WHEN h.question_id IS NOT NULL THEN 'held_out' END, origin, 'unknown') AS origin, count(*) AS items FROM question_items q LEFT JOIN (SELECT DISTINCT question_id FROM question_items WHERE set_name <> 'development') h USING (question_id) GROUP BY 1""",
    "set_operations": """WITH k AS (SELECT question_id, count(DISTINCT source.source_type) AS n, min(source.source_type) AS least FROM pool_chunks WHERE question_id IS NOT NULL GROUP BY 1) SELECT CASE WHEN n > 1 THEN 'both' ELSE 'only ' || least END AS channels, count(*) AS questions FROM k GROUP BY 1""",
    "exact_text_dedup": "SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS kept FROM documents WHERE text IS NOT NULL AND text <> '' GROUP BY 1 HAVING count(*) > 1",
    "chunk_constraints": """SELECT rule, count(*) AS broken FROM (
      SELECT 'span_is_positive' AS rule FROM pool_chunks WHERE NOT end_char > start_char
      UNION ALL SELECT 'span_fits_text' FROM pool_chunks WHERE NOT end_char - start_char = length(text)
      UNION ALL SELECT 'hash_fits_text' FROM pool_chunks WHERE NOT sha256(text) = content_hash
      UNION ALL SELECT 'fingerprints_agree' FROM pool_chunks WHERE NOT source_fingerprint = source.fingerprint
      UNION ALL SELECT 'year_is_plausible' FROM pool_chunks WHERE NOT source.year BETWEEN 1401 AND 2199
      UNION ALL SELECT 'citations_not_negative' FROM pool_chunks WHERE NOT source.citation_count >= 0
      UNION ALL SELECT 'score_within_one' FROM pool_chunks WHERE NOT isnan(source.relevance_score) AND NOT source.relevance_score BETWEEN 0 AND 1
      UNION ALL SELECT 'has_identifier' FROM pool_chunks WHERE coalesce(source.doi, source.url, source.external_id) IS NULL
      UNION ALL SELECT 'chunk_id_is_unique' FROM (SELECT chunk_id FROM pool_chunks GROUP BY 1 HAVING count(*) > 1)
      UNION ALL SELECT 'question_exists' FROM (SELECT DISTINCT question_id FROM pool_chunks WHERE question_id IS NOT NULL EXCEPT SELECT question_id FROM question_items)) GROUP BY rule""",
    "item_constraints": """SELECT rule, key, count(*) AS rows FROM (
      SELECT 'id_has_prefix' AS rule, question_id AS key FROM question_items WHERE NOT starts_with(question_id, CASE set_name WHEN 'development' THEN 'dev-' WHEN 'validation' THEN 'val-' WHEN 'test' THEN 'tst-' END)
      UNION ALL SELECT 'category_is_known', question_id FROM question_items WHERE category IS NULL
      UNION ALL SELECT 'id_is_unique', question_id FROM question_items GROUP BY 2 HAVING count(*) > 1) GROUP BY ALL""",
    "status_transitions": """WITH e AS (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
      a(x, y) AS (VALUES ('(start)', 'view'), ('(start)', 'signup'), ('signup', 'view'), ('view', 'view'), ('view', 'click'), ('click', 'view'), ('click', 'purchase'), ('click', 'click'), ('purchase', 'view'))
      SELECT coalesce(before, '(start)') AS before, event_type, count(*) AS events FROM e WHERE (coalesce(before, '(start)'), event_type) NOT IN (SELECT (x, y) FROM a) GROUP BY ALL""",
    "stage_totals": """SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS users, round(coalesce(sum(value), 0), 4) AS total FROM events GROUP BY 1 UNION ALL SELECT '(all)', count(*), count(DISTINCT user_id), round(coalesce(sum(value), 0), 4) FROM events""",
    "metric_rows": """WITH w AS (SELECT source.provider AS provider, CAST(count(*) AS DOUBLE) AS chunks, CAST(count(source.rank) AS DOUBLE) AS ranked, CAST(max(source.rank) AS DOUBLE) AS deepest, CAST(sum(length(text)) AS DOUBLE) AS characters FROM pool_chunks GROUP BY 1)
      SELECT provider, metric, value FROM (SELECT provider, 'chunks' AS metric, chunks AS value FROM w UNION ALL SELECT provider, 'ranked', ranked FROM w UNION ALL SELECT provider, 'deepest', deepest FROM w UNION ALL SELECT provider, 'characters', characters FROM w) WHERE value IS NOT NULL""",
    "token_costs": """WITH t AS (SELECT depth, CAST(sum(coalesce(length(text), 0) // 4) AS BIGINT) AS tokens FROM documents GROUP BY 1), p(prefix, price) AS (VALUES ('a', 1.0), ('abs', 2.0), ('full', 3.0)),
      b AS (SELECT depth, tokens, arg_max(price, length(prefix)) AS price FROM t LEFT JOIN p ON starts_with(depth, prefix) GROUP BY 1, 2) SELECT depth, tokens, CAST(round(tokens * price, 6) AS DOUBLE) AS cost FROM b""",
    "budget_fold": """WITH RECURSIVE e AS (SELECT user_id, coalesce(value, 0) AS cost, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
      r AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS n, CAST(0 AS DOUBLE) AS spent, CAST(0 AS BIGINT) AS admitted, CAST(0 AS BIGINT) AS refused FROM e
        UNION ALL SELECT r.user_id, e.n, CASE WHEN spent + cost > 100 THEN spent ELSE spent + cost END, admitted + CAST(spent + cost <= 100 AS BIGINT), refused + CAST(spent + cost > 100 AS BIGINT) FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
      SELECT user_id, max(admitted) AS admitted, max(refused) AS refused, round(max(spent), 4) AS spent FROM r GROUP BY 1""",
    "duplicate_flags": """WITH c AS (SELECT row_id, min(row_id) OVER (PARTITION BY question_id, content_hash) AS first FROM pool_chunks WHERE question_id IS NOT NULL AND content_hash IS NOT NULL) SELECT row_id, first FROM c WHERE row_id > first""",
    "section_spans": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE contains(text, '## ')),
      o AS (SELECT *, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_char, CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id) - 1 AS BIGINT) AS size FROM l)
      SELECT doc_id, substring(line, 4, 1000) AS heading, start_char, coalesce(lead(start_char) OVER (PARTITION BY doc_id ORDER BY n), size) AS end_char FROM o WHERE starts_with(line, '## ')""",
    "recent_pools": "SELECT question_id, pool_version FROM (SELECT DISTINCT question_id, pool_version, created_at FROM evidence_pools) ORDER BY created_at DESC, question_id, pool_version LIMIT 10 OFFSET 10",
    "sampled_order": "SELECT question_id FROM (SELECT DISTINCT question_id FROM question_items) ORDER BY sha256(question_id) LIMIT 20",
    "supplier_revenue": """SELECT r_name, count(*) AS lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(count(*) FILTER (WHERE l_returnflag = 'R') / count(*), 4) AS returned
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""",
    "order_gaps": "SELECT c_mktsegment, count(*) AS customers FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1",
}
