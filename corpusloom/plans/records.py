"""Look-ups, states, links, placements and violations over a run's records.

Bindings as in `claims`: chunks are claims of their question's report, sources
citations, pools runs; documents of a question are its draft, their headings sections.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import metrics as M
from corpusloom.functions import text as X
from corpusloom.operators import checks, dedup
from corpusloom.operators import shapes as S
from corpusloom.plans.claims import _claims
from corpusloom.sources.tables import table


def status_lookup(s: SparkSession, d: str) -> DataFrame:
    """The first 25 open orders by date and key: an equality filter with a limit, pushed to the scan."""
    o = S.looked_up(table(s, d, "orders"), {"o_orderstatus": ["O"]}, [None])
    return o.select("o_orderkey", "o_orderpriority").orderBy("o_orderkey").limit(25)


def claims_of_queries(s: SparkSession, d: str) -> DataFrame:
    """Chunks of the queries that the newest pools belong to, in the order of query and rank: rows whose key is in a list held as a table."""
    newest = table(s, d, "evidence_pools").groupBy("question_id").agg(F.max("created_at").alias("at")).filter("at >= timestamp_ntz'2020-01-01 00:00:00'").select("question_id")
    c = table(s, d, "pool_chunks").join(newest, "question_id", "left_semi").filter("source.query is not null")
    w = Window.partitionBy("source.query").orderBy(F.col("source.rank").asc_nulls_last(), "row_id")
    return c.select(F.col("source.query").alias("query"), "row_id", F.row_number().over(w).alias("n")).filter("n <= 3")


def existing_ids(s: SparkSession, d: str) -> DataFrame:
    """Of all question ids that chunks name, those that exist and those that do not."""
    refs = table(s, d, "pool_chunks").filter("question_id is not null").select("question_id").distinct()
    known = table(s, d, "evidence_pools").select("question_id").distinct().withColumn("there", F.lit(True))
    return refs.join(known, "question_id", "left").groupBy(F.coalesce("there", F.lit(False)).alias("exists")).agg(F.count("*").alias("ids"))


def ratio_metrics(s: SparkSession, d: str) -> DataFrame:
    """Names of figures, and whether each is a share by its name."""
    from corpusloom.plans.claims import citation_rates, claim_rates

    names = sorted({*claim_rates(s, d).columns, *citation_rates(s, d).columns} - {"arm"})
    return s.createDataFrame([(n,) for n in names], "metric string").select("metric", M.is_ratio(F.col("metric")).alias("share"))


def verification_states(s: SparkSession, d: str) -> DataFrame:
    """Per question, the rows that support and that contradict with a quotation, as two texts; neutral ones left out."""
    c = _claims(s, d).filter(F.length("quote") > 0)
    rows = lambda r: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("stated") == r, F.col("row_id")))), lambda x: x.cast("string")), ",")
    g = c.groupBy("question_id").agg(rows("supports").alias("supporting"), rows("contradicts").alias("contradicting"))
    return g.filter("supporting <> '' or contradicting <> ''")


def provider_prefix(s: SparkSession, d: str) -> DataFrame:
    """The first four chunks of each question in the providers' own order."""
    c = table(s, d, "pool_chunks").filter("question_id is not null")
    w = Window.partitionBy("question_id").orderBy(F.col("source.rank").asc_nulls_last(), F.col("position").asc_nulls_last(), "row_id")
    return c.select("question_id", "row_id", F.row_number().over(w).alias("place")).filter("place <= 4")


def quality_records(s: SparkSession, d: str) -> DataFrame:
    """Per question one row of all its kinds of record, each nested as a sorted text and aggregated before the join."""
    q = table(s, d, "question_items").groupBy("question_id").agg(F.array_join(F.array_sort(F.collect_set("set_name")), ",").alias("sets"))
    p = table(s, d, "evidence_pools").groupBy("question_id").agg(F.array_join(F.array_sort(F.collect_set("pool_version")), ",").alias("versions"))
    c = table(s, d, "pool_chunks").groupBy("question_id").agg(F.array_join(F.array_sort(F.collect_set("source.provider")), ",").alias("providers"), F.array_join(F.array_sort(F.collect_set("depth")), ",").alias("depths"))
    t = table(s, d, "documents").groupBy("question_id").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("languages"))
    j = q
    for other in (p, c, t):
        j = j.join(other, "question_id", "left")
    return j.fillna("", ["versions", "providers", "depths", "languages"])


def citation_violations(s: SparkSession, d: str) -> DataFrame:
    """Chunks that break rules of citations: a relation without its quotation, support by a source that does not support elsewhere in its report, a status that its evidence denies."""
    c = _claims(s, d)
    support = c.filter("stated = 'supports'").select("question_id", "fp").filter("fp is not null").distinct().withColumn("supported", F.lit(True))
    j = c.join(support, ["question_id", "fp"], "left")
    rules = {
        "relation_needs_its_quotation": (F.col("stated") == "neutral") | (F.contains("text", "quote")),
        "reuse_needs_support": (F.col("verdict") != "partially_supported") | F.col("supported").isNotNull(),
        "fabricated_names_no_source": F.col("fp").isNotNull() | F.col("verdict").isNull(),
        "contradicted_is_not_cited_as_support": ~((F.col("verdict") == "contradicted") & F.coalesce("supported", F.lit(False))),
    }
    rules = {k: F.coalesce(v, F.lit(False)) for k, v in rules.items()}
    return checks.breaking(j, rules, "row_id").groupBy("rule").agg(F.count("*").alias("rows"))


def revision_needed(s: SparkSession, d: str) -> DataFrame:
    """Reports that need a revision (any claim contradicted), that are partial (any not judged), or neither."""
    g = _claims(s, d).groupBy("question_id").agg(F.bool_or(F.coalesce(F.col("verdict") == "contradicted", F.lit(False))).alias("revise"), F.bool_or(F.col("verdict").isNull()).alias("partial"))
    return g.groupBy("revise", "partial").agg(F.count("*").alias("reports"))


def restored_sections(s: SparkSession, d: str) -> DataFrame:
    """Planned statements of questions that no chunk's first sentence states, put back in plan order after those stated."""
    q = table(s, d, "question_items").filter("expected_evidence is not null").groupBy("question_id").agg(F.max("expected_evidence").alias("plan"))
    p = q.select("question_id", F.posexplode("plan").alias("position", "statement"))
    said = table(s, d, "pool_chunks").filter("text is not null").select("question_id", F.lower(F.substring("text", 1, 12)).alias("head")).distinct().withColumn("said", F.lit(1))
    j = p.withColumn("head", F.lower(F.substring("statement", 1, 12))).join(said, ["question_id", "head"], "left")
    w = Window.partitionBy("question_id").orderBy(F.col("said").asc_nulls_last(), "position")
    return j.select("question_id", "position", F.col("said").isNull().alias("restored"), (F.row_number().over(w) - 1).alias("place"))


def first_placements(s: SparkSession, d: str) -> DataFrame:
    """The first place of each source in its report: query, rank and row of its first use, per provider and rank."""
    c = table(s, d, "pool_chunks").filter("question_id is not null and source_fingerprint is not null")
    f = c.groupBy("question_id", "source_fingerprint").agg(F.min_by(F.struct(F.col("source.provider").alias("provider"), F.col("source.rank").alias("rank")), "row_id").alias("p"))
    return f.groupBy("p.provider", "p.rank").agg(F.count("*").alias("sources"))


def both_channels(s: SparkSession, d: str) -> DataFrame:
    """Texts of both channels as one list: non-empty contents of pages and abstracts of papers, per kind and provider."""
    w = table(s, d, "web_results").select(F.lit("web").alias("kind"), "provider", F.col("content").alias("text"))
    p = table(s, d, "paper_records").select(F.lit("paper").alias("kind"), "provider", F.col("abstract").alias("text"))
    return w.unionByName(p).filter(F.trim(F.coalesce("text", F.lit(""))) != "").groupBy("kind", "provider").agg(F.count("*").alias("passages"), F.sum(F.length("text")).alias("characters"))


def flat_rows(s: SparkSession, d: str) -> DataFrame:
    """Chunks with their nested source flattened to plain columns, lists as texts, as a results file holds them."""
    c = table(s, d, "pool_chunks")
    return c.select("row_id", F.coalesce("source.provider", F.lit("—")).alias("provider"), F.coalesce(F.col("source.year").cast("string"), F.lit("—")).alias("year"), F.coalesce(F.nullif(F.array_join("source.authors", "; "), F.lit("")), F.lit("—")).alias("authors"), F.coalesce(F.col("source.rank").cast("string"), F.lit("—")).alias("rank"))


def usage_known_and_estimated(s: SparkSession, d: str) -> DataFrame:
    """Per depth, characters that are measured and tokens that are estimated, kept apart; rows without text count as unknown."""
    t = table(s, d, "documents")
    return t.groupBy("depth").agg(F.count("text").alias("measured"), F.count_if(F.col("text").isNull()).alias("unknown"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("characters"), F.coalesce(F.sum(X.estimated_tokens(F.col("text"))), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("most"))


def unresolved_claims(s: SparkSession, d: str) -> DataFrame:
    """Claims that nothing supports, with where they stand: per verdict and depth, claims and reports."""
    c = _claims(s, d).filter(~F.coalesce(F.col("verdict").isin("supported", "partially_supported"), F.lit(False)))
    return c.groupBy(F.coalesce("verdict", F.lit("(not judged)")).alias("verdict"), "depth").agg(F.count("*").alias("claims"), F.countDistinct("question_id").alias("reports"))


def supported_chunks(s: SparkSession, d: str) -> DataFrame:
    """Per report, the chunk ids whose outcome supports, each once and sorted, and whether any citation is known."""
    c = _claims(s, d).select("question_id", "row_id", "stated").join(table(s, d, "pool_chunks").select("row_id", "chunk_id"), "row_id")
    g = c.groupBy("question_id").agg(F.array_sort(F.collect_set(F.when(F.col("stated") == "supports", F.col("chunk_id")))).alias("ids"))
    return g.select("question_id", F.size("ids").alias("supporting"), F.sha2(F.array_join("ids", ","), 256).alias("ids_hash"))


def rendered_markers(s: SparkSession, d: str) -> DataFrame:
    """Distinct years of bracketed citations that chunks carry, in the order of first sight, as markers."""
    t = table(s, d, "pool_chunks").filter("text is not null").select("row_id", F.array_distinct(F.regexp_extract_all("text", F.lit(r"\([^()]*, (\d{4})\)"), F.lit(1))).alias("m"))
    return t.select("row_id", F.array_join(F.filter("m", lambda x: x != ""), ",").alias("markers")).filter("markers <> ''")


def prefixed_settings(s: SparkSession, d: str) -> DataFrame:
    """Settings of pools whose name begins with `web_`, as a map that keeps only these."""
    e = table(s, d, "evidence_pools").select("pool_version", F.map_filter(F.create_map(F.lit("web_results"), "web_results_requested", F.lit("academic_results"), "academic_results_requested"), lambda k, v: F.startswith(k, F.lit("web_")) & v.isNotNull()).alias("m"))
    return e.select("pool_version", F.explode("m").alias("setting", "value")).groupBy("pool_version", "setting").agg(F.count("*").alias("pools"), F.sum("value").alias("total"))


def marked_gaps(s: SparkSession, d: str) -> DataFrame:
    """Questions flagged as gaps (no chunk) per set, and links of sources to questions that exist: rows of an association."""
    have = table(s, d, "pool_chunks").filter("question_id is not null").groupBy("question_id").agg(F.countDistinct("source_fingerprint").alias("links"))
    q = table(s, d, "question_items").groupBy("question_id").agg(F.min("set_name").alias("set_name"))
    j = q.join(have, "question_id", "left")
    return j.groupBy("set_name").agg(F.count_if(F.col("links").isNull()).alias("gaps"), F.coalesce(F.sum("links"), F.lit(0)).alias("links"))


def section_matches(s: SparkSession, d: str) -> DataFrame:
    """Titles of documents that are also a heading of another, compared in lower case without spaces at the ends."""
    t = table(s, d, "documents").filter("title is not null").select("doc_id", F.lower(F.trim("title")).alias("k"))
    h = table(s, d, "documents").filter("title is not null and lang = 'en'").select(F.lower(F.trim("title")).alias("k")).distinct().withColumn("heading", F.lit(1))
    return t.join(h, "k", "left").groupBy(F.col("heading").isNotNull().alias("matched")).agg(F.count("*").alias("documents"))


def mode_settings(s: SparkSession, d: str) -> DataFrame:
    """Settings of a run by its mode: retrieval fields only for those that retrieve; rows whose settings do not match their mode."""
    p = table(s, d, "evidence_pools").select("question_id", "web_results_requested", "academic_results_requested")
    mode = F.when((F.col("web_results_requested") > 0) & (F.col("academic_results_requested") > 0), "hybrid").when(F.col("web_results_requested") > 0, "web").when(F.col("academic_results_requested") > 0, "papers").otherwise("model_only")
    top = F.when(F.col("mode") != "model_only", F.greatest("web_results_requested", "academic_results_requested"))
    return p.withColumn("mode", mode).groupBy("mode", top.alias("top_k")).agg(F.count("*").alias("pools"))


def evidence_split(s: SparkSession, d: str) -> DataFrame:
    """Per report its passages split by relation in one pass, and whether the decisive one (the best) is among those listed."""
    c = _claims(s, d)
    g = c.groupBy("question_id").agg(
        F.count_if(F.col("stated") == "supports").alias("supporting"), F.count_if(F.col("stated") == "contradicts").alias("contradicting"), F.max_by("row_id", F.struct("s", "row_id")).alias("decisive"), F.collect_set(F.when(F.col("rank") <= 5, F.col("row_id"))).alias("listed")
    )
    return g.select("question_id", "supporting", "contradicting", F.array_contains("listed", F.col("decisive")).alias("decisive_listed"))


def upserted_audits(s: SparkSession, d: str) -> DataFrame:
    """Deliveries of one chunk id: the last wins, and whether it agrees with the first; chunk ids by number of deliveries."""
    c = table(s, d, "pool_chunks").filter("chunk_id is not null").select("chunk_id", "row_id", "content_hash")
    last = dedup.latest(c, ["chunk_id"], [F.col("row_id")]).select("chunk_id", F.col("content_hash").alias("last_hash"))
    g = c.groupBy("chunk_id").agg(F.min_by("content_hash", "row_id").alias("first_hash"), F.count("*").alias("deliveries"))
    return g.join(last, "chunk_id").groupBy("deliveries", F.col("first_hash").eqNullSafe(F.col("last_hash")).alias("agree")).agg(F.count("*").alias("chunks"))


QUERIES = {
    f.__name__: f
    for f in (status_lookup, claims_of_queries, existing_ids, ratio_metrics, verification_states, provider_prefix, quality_records, citation_violations, revision_needed, restored_sections, first_placements, both_channels, flat_rows, usage_known_and_estimated, unresolved_claims, supported_chunks, rendered_markers, prefixed_settings, marked_gaps, section_matches, mode_settings, evidence_split, upserted_audits)
}

from corpusloom.plans.claims import _C, _TOP  # noqa: E402

_SET = "coalesce(array_to_string(list_sort(list_distinct(list({}) FILTER (WHERE {} IS NOT NULL))), ','), '')"

ORACLE = {
    "status_lookup": "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 25",
    "claims_of_queries": """WITH n AS (SELECT source.query AS query, row_id, CAST(row_number() OVER (PARTITION BY source.query ORDER BY source.rank ASC NULLS LAST, row_id) AS INTEGER) AS n FROM pool_chunks WHERE source.query IS NOT NULL AND question_id IN (SELECT question_id FROM evidence_pools GROUP BY 1 HAVING max(created_at) >= TIMESTAMP '2020-01-01 00:00:00'))
      SELECT query, row_id, n FROM n WHERE n <= 3""",
    "existing_ids": "WITH r AS (SELECT DISTINCT question_id FROM pool_chunks WHERE question_id IS NOT NULL) SELECT question_id IN (SELECT question_id FROM evidence_pools WHERE question_id IS NOT NULL) AS exists, count(*) AS ids FROM r GROUP BY 1",
    "ratio_metrics": "SELECT metric, regexp_matches(metric, '_(rate|precision|recall|coverage)$') AS share FROM (SELECT unnest(['claims', 'requiring', 'support_rate', 'unsupported_rate', 'contradiction_rate', 'hallucinations', 'citation_precision', 'citation_coverage', 'fabricated']) AS metric)",
    "verification_states": f"""WITH {_C}, g AS (SELECT question_id, coalesce(string_agg(CAST(row_id AS VARCHAR), ',' ORDER BY row_id) FILTER (WHERE stated = 'supports'), '') AS supporting, coalesce(string_agg(CAST(row_id AS VARCHAR), ',' ORDER BY row_id) FILTER (WHERE stated = 'contradicts'), '') AS contradicting FROM v WHERE length(quote) > 0 GROUP BY 1)
      SELECT * FROM g WHERE supporting <> '' OR contradicting <> ''""",
    "provider_prefix": "WITH n AS (SELECT question_id, row_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY source.rank ASC NULLS LAST, position ASC NULLS LAST, row_id) AS INTEGER) AS place FROM pool_chunks WHERE question_id IS NOT NULL) SELECT * FROM n WHERE place <= 4",
    "quality_records": f"""WITH q AS (SELECT question_id, {_SET.format('set_name', 'set_name')} AS sets FROM question_items GROUP BY 1), p AS (SELECT question_id, {_SET.format('pool_version', 'pool_version')} AS versions FROM evidence_pools GROUP BY 1),
      c AS (SELECT question_id, {_SET.format('source.provider', 'source.provider')} AS providers, {_SET.format('depth', 'depth')} AS depths FROM pool_chunks GROUP BY 1), t AS (SELECT question_id, {_SET.format('lang', 'lang')} AS languages FROM documents GROUP BY 1)
      SELECT question_id, sets, coalesce(versions, '') AS versions, coalesce(providers, '') AS providers, coalesce(depths, '') AS depths, coalesce(languages, '') AS languages FROM q LEFT JOIN p USING (question_id) LEFT JOIN c USING (question_id) LEFT JOIN t USING (question_id)""",
    "citation_violations": f"""WITH {_C}, u AS (SELECT DISTINCT question_id, fp, true AS supported FROM v WHERE stated = 'supports' AND fp IS NOT NULL), j AS (SELECT v.*, supported FROM v LEFT JOIN u ON v.question_id = u.question_id AND v.fp = u.fp),
      r AS (SELECT unnest(list_filter([CASE WHEN NOT coalesce(stated = 'neutral' OR contains(text, quote), false) THEN 'relation_needs_its_quotation' END, CASE WHEN NOT coalesce(verdict <> 'partially_supported' OR supported IS NOT NULL, false) THEN 'reuse_needs_support' END,
        CASE WHEN NOT (fp IS NOT NULL OR verdict IS NULL) THEN 'fabricated_names_no_source' END, CASE WHEN NOT coalesce(NOT (verdict = 'contradicted' AND coalesce(supported, false)), false) THEN 'contradicted_is_not_cited_as_support' END], lambda x: x IS NOT NULL)) AS rule FROM j) SELECT rule, count(*) AS rows FROM r GROUP BY 1""",
    "revision_needed": f"WITH {_C}, g AS (SELECT question_id, bool_or(coalesce(verdict = 'contradicted', false)) AS revise, bool_or(verdict IS NULL) AS partial FROM v GROUP BY 1) SELECT revise, partial, count(*) AS reports FROM g GROUP BY ALL",
    "restored_sections": """WITH q AS (SELECT question_id, max(expected_evidence) AS plan FROM question_items WHERE expected_evidence IS NOT NULL GROUP BY 1), p AS (SELECT question_id, unnest(plan) AS s, generate_subscripts(plan, 1) - 1 AS position FROM q),
      h AS (SELECT DISTINCT question_id, lower(substring(text, 1, 12)) AS head, 1 AS said FROM pool_chunks WHERE text IS NOT NULL), j AS (SELECT p.question_id, position, said FROM p LEFT JOIN h ON p.question_id = h.question_id AND lower(substring(s, 1, 12)) = head)
      SELECT question_id, CAST(position AS INTEGER) AS position, said IS NULL AS restored, CAST(row_number() OVER (PARTITION BY question_id ORDER BY said ASC NULLS LAST, position) - 1 AS INTEGER) AS place FROM j""",
    "first_placements": "WITH f AS (SELECT question_id, source_fingerprint, arg_min({'provider': source.provider, 'rank': source.rank}, row_id) AS p FROM pool_chunks WHERE question_id IS NOT NULL AND source_fingerprint IS NOT NULL GROUP BY ALL) SELECT p.provider AS provider, p.rank AS rank, count(*) AS sources FROM f GROUP BY ALL",
    "both_channels": "WITH t AS (SELECT 'web' AS kind, provider, content AS text FROM web_results UNION ALL SELECT 'paper', provider, abstract FROM paper_records) SELECT kind, provider, count(*) AS passages, CAST(sum(length(text)) AS BIGINT) AS characters FROM t WHERE trim(coalesce(text, '')) <> '' GROUP BY ALL",
    "flat_rows": "SELECT row_id, coalesce(source.provider, '—') AS provider, coalesce(CAST(source.year AS VARCHAR), '—') AS year, coalesce(nullif(array_to_string(source.authors, '; '), ''), '—') AS authors, coalesce(CAST(source.rank AS VARCHAR), '—') AS rank FROM pool_chunks",
    "usage_known_and_estimated": "SELECT depth, count(text) AS measured, count(*) FILTER (WHERE text IS NULL) AS unknown, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS characters, CAST(coalesce(sum(coalesce(length(text), 0) // 4), 0) AS BIGINT) AS tokens, CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) AS most FROM documents GROUP BY 1",
    "unresolved_claims": f"WITH {_C} SELECT coalesce(verdict, '(not judged)') AS verdict, depth, count(*) AS claims, count(DISTINCT question_id) AS reports FROM v WHERE NOT coalesce(verdict IN ('supported', 'partially_supported'), false) GROUP BY ALL",
    "supported_chunks": f"WITH {_C}, g AS (SELECT v.question_id, list_sort(list_distinct(list(p.chunk_id) FILTER (WHERE stated = 'supports' AND p.chunk_id IS NOT NULL))) AS ids FROM v JOIN pool_chunks p USING (row_id) GROUP BY 1) SELECT question_id, CAST(coalesce(len(ids), 0) AS INTEGER) AS supporting, sha256(coalesce(array_to_string(ids, ','), '')) AS ids_hash FROM g",
    "rendered_markers": """WITH t AS (SELECT row_id, unnest(regexp_extract_all(text, '\\([^()]*, (\\d{4})\\)', 1)) AS m, generate_subscripts(regexp_extract_all(text, '\\([^()]*, (\\d{4})\\)', 1), 1) AS n FROM pool_chunks WHERE text IS NOT NULL),
      f AS (SELECT row_id, m, min(n) AS n FROM t WHERE m <> '' GROUP BY ALL) SELECT row_id, string_agg(m, ',' ORDER BY n) AS markers FROM f GROUP BY 1""",
    "prefixed_settings": "SELECT pool_version, 'web_results' AS setting, count(*) AS pools, CAST(sum(web_results_requested) AS BIGINT) AS total FROM evidence_pools WHERE web_results_requested IS NOT NULL GROUP BY 1",
    "marked_gaps": "WITH h AS (SELECT question_id, count(DISTINCT source_fingerprint) AS links FROM pool_chunks WHERE question_id IS NOT NULL GROUP BY 1), q AS (SELECT question_id, min(set_name) AS set_name FROM question_items GROUP BY 1) SELECT set_name, count(*) FILTER (WHERE links IS NULL) AS gaps, CAST(coalesce(sum(links), 0) AS BIGINT) AS links FROM q LEFT JOIN h USING (question_id) GROUP BY 1",
    "section_matches": "SELECT lower(trim(title)) IN (SELECT lower(trim(title)) FROM documents WHERE title IS NOT NULL AND lang = 'en') AS matched, count(*) AS documents FROM documents WHERE title IS NOT NULL GROUP BY 1",
    "mode_settings": """WITH m AS (SELECT *, CASE WHEN web_results_requested > 0 AND academic_results_requested > 0 THEN 'hybrid' WHEN web_results_requested > 0 THEN 'web' WHEN academic_results_requested > 0 THEN 'papers' ELSE 'model_only' END AS mode FROM evidence_pools)
      SELECT mode, CASE WHEN mode <> 'model_only' THEN greatest(web_results_requested, academic_results_requested) END AS top_k, count(*) AS pools FROM m GROUP BY ALL""",
    "evidence_split": f"""WITH {_C}, g AS (SELECT question_id, count(*) FILTER (WHERE stated = 'supports') AS supporting, count(*) FILTER (WHERE stated = 'contradicts') AS contradicting, {_TOP.replace('verdict', 'row_id', 1)} AS decisive FROM v GROUP BY 1)
      SELECT question_id, supporting, contradicting, decisive IN (SELECT row_id FROM pool_chunks WHERE source.rank <= 5) AS decisive_listed FROM g""",
    "upserted_audits": "WITH g AS (SELECT chunk_id, arg_min(content_hash, row_id) AS a, arg_max(content_hash, row_id) AS b, count(*) AS deliveries FROM pool_chunks WHERE chunk_id IS NOT NULL GROUP BY 1) SELECT deliveries, a IS NOT DISTINCT FROM b AS agree, count(*) AS chunks FROM g GROUP BY ALL",
}
