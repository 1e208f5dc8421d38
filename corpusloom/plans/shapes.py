"""Lookups, nested and rendered results, constraint matrices, accounts and pairs.

Bindings: a pool is a run with its requested results as configuration, a chunk a
passage of its question, sources get labels S1, S2, ... by first use; events are a
run's attempts with their props as usage; headings are a document's sections.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import identity as I
from corpusloom.functions import metrics as M
from corpusloom.functions import text as X
from corpusloom.operators import checks, retrieval
from corpusloom.operators import shapes as S
from corpusloom.sources.tables import table

NEWS = ("newsgrid", "webscout")


def _passages(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "pool_chunks").filter("question_id is not null")
    return c.select("question_id", "row_id", "chunk_id", "document_id", "position", "text", "depth", "source_fingerprint", "start_char", "end_char", "content_hash", "source")


def provider_results(s: SparkSession, d: str) -> DataFrame:
    """Per provider: results, those without a usable address, scores outside [0, 1], blank contents, and results left."""
    w = S.provider_results(table(s, d, "web_results"))
    return w.groupBy("provider").agg(
        F.count("*").alias("results"), F.count_if(~F.col("usable")).alias("malformed"), F.count_if(F.col("clamped")).alias("clamped"), F.count_if(F.col("snippet").isNull()).alias("without_text"), F.round(F.sum("score"), 4).alias("score"),
    )


def searched_hosts(s: SparkSession, d: str) -> DataFrame:
    """Results of two providers outside a list of hosts, the first ten of each query by rank: hosts and results per provider."""
    w = table(s, d, "web_results").filter(F.col("provider").isin(*NEWS) & F.col("query").isNotNull())
    w = w.withColumn("host", I.host_of(F.col("url"))).filter(~F.col("host").isin("dailymarrow.test", "plainfacts.invalid"))
    top = w.withColumn("n", F.row_number().over(Window.partitionBy("provider", "query").orderBy(F.col("rank").asc_nulls_last(), "web_key"))).filter("n <= 10")
    return top.groupBy("provider").agg(F.count("*").alias("results"), F.countDistinct("host").alias("hosts"))


def failed_queries(s: SparkSession, d: str) -> DataFrame:
    """Per query, providers asked and those that gave nothing readable; whether all failed."""
    w = table(s, d, "web_results").filter("query is not null").groupBy("query", "provider").agg(F.count("content").alias("readable"))
    return w.groupBy("query").agg(F.count("*").alias("asked"), F.count_if(F.col("readable") == 0).alias("failed"), (F.count_if(F.col("readable") == 0) == F.count("*")).alias("all_failed"))


def pool_lookup(s: SparkSession, d: str) -> DataFrame:
    """Pools of held-out questions that asked both channels, newest version first within a question."""
    q = table(s, d, "question_items").select("question_id", "set_name").distinct()
    p = table(s, d, "evidence_pools").select("question_id", "pool_version", "web_results_requested", "academic_results_requested").distinct()
    j = S.looked_up(p.join(q, "question_id"), {"set_name": ["validation", "test"]}, [(F.col("web_results_requested") > 0), (F.col("academic_results_requested") > 0), None])
    return j.select("question_id", "set_name", "pool_version", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("pool_version"), "set_name")).alias("place"))


def configuration_fingerprints(s: SparkSession, d: str) -> DataFrame:
    """A fingerprint of each pool's settings; the academic setting counts only where it is set, so older ones keep theirs."""
    p = table(s, d, "evidence_pools").select("question_id", "pool_version", "web_results_requested", "academic_results_requested").distinct()
    made = S.configuration_fingerprint(["pool_version", "web_results_requested"], ["academic_results_requested"])
    return p.select(made.alias("fingerprint")).groupBy("fingerprint").agg(F.count("*").alias("pools"))


def results_per_question(s: SparkSession, d: str) -> DataFrame:
    """Per category, results that each of its questions gets of 50, at least two."""
    q = table(s, d, "question_items").filter("category is not null").groupBy("category").agg(F.countDistinct("question_id").alias("questions"))
    return q.select("category", "questions", F.greatest(F.lit(2), F.ceil(F.lit(50) / F.greatest(F.lit(1), F.col("questions")))).cast("long").alias("results_each"))


def claim_order(s: SparkSession, d: str) -> DataFrame:
    """Questions of each category in order of importance, core ones, then reading order; which fall within a cap of 20 less a reserve of a quarter."""
    q = table(s, d, "question_items").filter("category is not null").groupBy("category", "question_id").agg(
        F.max(F.coalesce("premise_is_false", F.lit(False))).alias("important"), F.max((F.col("difficulty") == "hard").cast("int")).alias("core")
    )
    w = Window.partitionBy("category").orderBy(F.desc("important"), F.desc_nulls_last("core"), "question_id")
    return q.select("category", "question_id", (F.row_number().over(w) - 1).alias("priority_rank")).withColumn("outcome", F.when(F.col("priority_rank") < S.initial_cap(20, 0.25), "verified").otherwise("claim_cap"))


def evidence_blocks(s: SparkSession, d: str) -> DataFrame:
    """The heading of each passage as a reader would cite it, hashed with its text; per depth, how many blocks and characters."""
    p = _passages(s, d)
    block = S.evidence_block(F.concat(F.lit("P"), F.col("row_id").cast("string")), F.col("source"), F.col("depth"), F.col("text"))
    return p.groupBy("depth").agg(F.count("*").alias("blocks"), F.sum(F.length(block)).alias("characters"), F.min(F.sha2(block, 256)).alias("least_hash"))


def source_sections(s: SparkSession, d: str) -> DataFrame:
    """Per question its labelled sources in the order of their numbers, as one text."""
    c = table(s, d, "pool_chunks").select("question_id", "source_fingerprint", "row_id").filter("question_id is not null and source_fingerprint is not null")
    labelled = retrieval.first_use_labels(c, "question_id", "source_fingerprint", "row_id")
    return labelled.groupBy("question_id").agg(S.by_number("label", F.concat_ws(" x", "label", F.col("uses").cast("string"))).alias("sources"))


def marked_sentences(s: SparkSession, d: str) -> DataFrame:
    """Per question and document, the first chunk's ending with the markers of the document's sources before the closing mark."""
    c = table(s, d, "pool_chunks").filter("question_id is not null and source_fingerprint is not null and document_id is not null and text is not null").select("question_id", "document_id", "source_fingerprint", "row_id", "text")
    labelled = retrieval.first_use_labels(c.select("question_id", "source_fingerprint", "row_id"), "question_id", "source_fingerprint", "row_id").select("question_id", "source_fingerprint", "label")
    first = c.groupBy("question_id", "document_id").agg(F.min_by(F.right("text", F.lit(40)), "row_id").alias("ending"))
    marks = c.select("question_id", "document_id", "source_fingerprint").distinct().join(labelled, ["question_id", "source_fingerprint"]).groupBy("question_id", "document_id").agg(S.numbered_labels("label").alias("labels"))
    return first.join(marks, ["question_id", "document_id"]).select("question_id", "document_id", S.with_markers(F.col("ending"), F.col("labels")).alias("line"))


def verification_summary(s: SparkSession, d: str) -> DataFrame:
    """Per question, nested: its passages by document in order, its sources by label, and how many conflicts are known; as texts."""
    p = _passages(s, d)
    docs = p.groupBy("question_id", "document_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("position", "row_id"))).getField("row_id").cast("array<string>"), ",").alias("rows"))
    nested = docs.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("document_id", F.lit("")).alias("k"), "rows"))), lambda x: F.concat(x["k"], F.lit(":"), x["rows"])), ";").alias("passages"))
    labels = retrieval.first_use_labels(p.filter("source_fingerprint is not null"), "question_id", "source_fingerprint", "row_id").groupBy("question_id").agg(F.count("*").alias("sources"))
    conflicts = table(s, d, "question_items").groupBy("question_id").agg(F.max(F.coalesce(F.size("known_conflicts"), F.lit(0))).alias("conflicts"))
    return nested.join(labels, "question_id", "left").join(conflicts, "question_id", "left").select("question_id", "passages", F.coalesce("sources", F.lit(0)).alias("sources"), F.coalesce(F.greatest("conflicts", F.lit(0)), F.lit(0)).alias("conflicts"))


def record_constraints(s: SparkSession, d: str) -> DataFrame:
    """Rules of papers, pages, pools and shares that rows break, and how many break each."""
    paper = table(s, d, "paper_records").select("paper_key", F.when(F.col("abstract").isNotNull(), "abstract").otherwise("metadata").alias("depth"), "abstract", "year", "doi", "url", "paper_id", "citation_count", "influential_citation_count")
    found = checks.breaking(paper, {
        "depth_matches_abstract": (F.col("depth") == "abstract") == (F.length(F.coalesce("abstract", F.lit(""))) > 0), "influential_within_citations": F.col("influential_citation_count") <= F.col("citation_count"),
        "doi_begins_with_10": F.startswith(F.lower("doi"), F.lit("10.")), "paper_is_identifiable": F.coalesce("doi", "url", "paper_id").isNotNull(),
    }, "paper_key")
    page = table(s, d, "web_results")
    found = found.unionByName(checks.breaking(page, {"page_has_an_address": F.col("url").isNotNull(), "page_has_no_doi_elsewhere": F.col("doi").isNull() | F.contains("url", "doi"), "rank_is_positive": F.col("rank") > 0}, "web_key"))
    pool = table(s, d, "evidence_pools")
    found = found.unionByName(checks.breaking(pool, {"pool_asks_something": F.col("web_results_requested") + F.col("academic_results_requested") > 0, "pool_has_a_hash": F.length(F.coalesce("content_hash", F.lit(""))) == 64}, "question_id"))
    share = table(s, d, "pool_chunks").groupBy(F.col("source.provider").alias("provider")).agg(F.count("source.rank").alias("n"), F.count("*").alias("d")).withColumn("value", F.round(F.col("n") / F.col("d"), 1))
    found = found.unionByName(checks.breaking(share, S.ratio_rules("value", "n", "d", 0.005), "provider"))
    return found.groupBy("rule").agg(F.count("*").alias("broken"))


def quote_offsets(s: SparkSession, d: str) -> DataFrame:
    """Where a chunk's own middle, as a quotation, stands in the chunk and in its document; the offsets must span it."""
    p = _passages(s, d).filter(F.length("text") > 0).withColumn("quote", F.substring("text", F.floor(F.length("text") / 2).cast("int"), F.lit(40)))
    j = p.withColumn("at", X.quote_span(F.col("text"), F.col("quote"))).filter("at is not null")
    return j.select("row_id", F.col("at.start").alias("quote_start"), F.col("at.end").alias("quote_end"), (F.col("start_char") + F.col("at.start")).alias("document_start"), (F.col("at.end") - F.col("at.start") == F.length("quote")).alias("agrees"))


def passage_relevance(s: SparkSession, d: str) -> DataFrame:
    """Per question: passages, those that share half of the long words of an expected statement, and statements covered so."""
    q = table(s, d, "question_items").filter("expected_evidence is not null").select("question_id", F.explode("expected_evidence").alias("statement")).distinct()
    p = _passages(s, d).select("question_id", "row_id", X.long_words(F.col("text")).alias("words"))
    j = p.join(q.withColumn("wanted", X.long_words(F.col("statement"))), "question_id").filter(F.size(F.array_intersect("words", "wanted")) * 2 >= F.size("wanted"))
    hit = j.groupBy("question_id", "row_id").agg(F.collect_set("statement").alias("covers"))
    j = p.drop("words").join(hit, ["question_id", "row_id"], "left")
    return j.groupBy("question_id").agg(F.count("*").alias("passages"), F.count("covers").alias("relevant"), F.size(F.array_distinct(F.flatten(F.collect_list("covers")))).alias("covered"))


def label_agreement(s: SparkSession, d: str) -> DataFrame:
    """Per set, items whose stored category is among the acceptable ones: that of the id, and for hard items false premises too."""
    q = table(s, d, "question_items").filter("category is not null")
    expected = F.regexp_extract("question_id", r"^[a-z]+-(.+)-\d+$", 1)
    acceptable = F.when(F.col("difficulty") == "hard", F.array(expected, F.lit("false_premise")))
    return q.groupBy("set_name").agg(F.count("*").alias("items"), M.rate(F.array_contains(F.coalesce(acceptable, F.array(expected)), F.col("category"))).alias("agreement"))


def last_attempts(s: SparkSession, d: str) -> DataFrame:
    """Users by the status of their last attempt, and how many attempts they made at most."""
    e = table(s, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("reason"), F.count("*").alias("attempts"))
    return e.groupBy("reason").agg(F.count("*").alias("users"), F.max("attempts").alias("most_attempts"))


def usage_sums(s: SparkSession, d: str) -> DataFrame:
    """Sums of every key of the events' props, per type of event."""
    e = table(s, d, "events").select("event_type", F.explode(F.from_json("props", "map<string,bigint>")).alias("key", "amount"))
    return e.groupBy("event_type", "key").agg(F.sum("amount").alias("total"), F.count("*").alias("events"))


def stage_record(s: SparkSession, d: str) -> DataFrame:
    """Per user the totals of each stage as one text by stage: a nested account."""
    e = table(s, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    listed = F.array_sort(F.collect_list(F.struct("event_type", "n", "cents")))
    return e.groupBy("user_id").agg(F.array_join(F.transform(listed, lambda x: F.concat_ws(":", x["event_type"], x["n"].cast("string"), x["cents"].cast("string"))), ",").alias("stages"), F.sum("cents").alias("cents"))


def metric_maps(s: SparkSession, d: str) -> DataFrame:
    """Long metric rows of each provider gathered to a map and read back by key."""
    from corpusloom.plans.evidence import metric_rows

    m = metric_rows(s, d).groupBy("provider").agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("m"))
    return m.select("provider", F.size("m").alias("metrics"), F.col("m")["chunks"].alias("chunks"), F.col("m")["deepest"].alias("deepest"))


def worst_by_family(s: SparkSession, d: str) -> DataFrame:
    """The highest price and the largest size of each family of parts, the first word of the type."""
    p = table(s, d, "part").groupBy(F.substring_index("p_type", " ", 1).alias("family"))
    return p.agg(F.max("p_retailprice").alias("price"), F.max("p_size").alias("size"), F.count("*").alias("parts"))


def plain_questions(s: SparkSession, d: str) -> DataFrame:
    """Questions without the first opening that matches, by the opening taken off."""
    q = table(s, d, "question_items").filter("question is not null").select("question_id", "question").distinct()
    rx = r"(?i)^\s*(what did|what is|does|do|is it true that|how do|which|why did|can|for|by|to what extent does)\s+"
    return q.groupBy(F.lower(F.regexp_extract("question", rx, 1)).alias("opening")).agg(F.count("*").alias("questions"), F.min(F.sha2(F.regexp_replace("question", rx, ""), 256)).alias("least_hash"))


def repeated_sections(s: SparkSession, d: str) -> DataFrame:
    """Headings that a document has more than once, by their text in lower case, and planned ones that documents with headings lack."""
    t = table(s, d, "documents").filter(F.contains("text", F.lit("## "))).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter(F.startswith("line", F.lit("## ")))
    h = t.select("doc_id", F.lower(F.trim(F.substring("line", 4, 1000))).alias("heading"))
    often = h.groupBy("doc_id", "heading").agg(F.count("*").alias("n")).filter("n > 1").groupBy("heading").agg(F.lit("repeated").alias("issue"), F.count("*").alias("documents"))
    total = h.agg(F.countDistinct("doc_id").alias("all")).first()["all"]  # one number
    have = h.groupBy("heading").agg(F.countDistinct("doc_id").alias("n")).filter("n >= 5").withColumn("all", F.lit(total))
    return often.select("heading", "issue", "documents").unionByName(have.select("heading", F.lit("missing").alias("issue"), (F.col("all") - F.col("n")).alias("documents")))


def plan_positions(s: SparkSession, d: str) -> DataFrame:
    """Questions of each category numbered from 0 by creation, and whether two share a position's date."""
    q = table(s, d, "question_items").filter("category is not null").groupBy("category", "question_id").agg(F.min("created").alias("created"))
    w = Window.partitionBy("category").orderBy(F.col("created").asc_nulls_last(), "question_id")
    return q.select("category", "question_id", (F.row_number().over(w) - 1).alias("position"), (F.lag("created").over(w) == F.col("created")).alias("same_date"))


def section_links(s: SparkSession, d: str) -> DataFrame:
    """The first and the last document of a question that have sections: sections linked by position, and whether the headings agree in order."""
    from corpusloom.plans.evidence import section_spans

    t = table(s, d, "documents").filter("question_id is not null").filter(F.contains("text", F.lit("## "))).groupBy("question_id").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b")
    w = Window.partitionBy("doc_id").orderBy("start_char")
    sec = section_spans(s, d).select("doc_id", "heading", (F.row_number().over(w) - 1).alias("position"))
    left = t.join(sec.select(F.col("doc_id").alias("a"), "position", F.col("heading").alias("ha")), "a")
    j = left.join(sec.select(F.col("doc_id").alias("b"), "position", F.col("heading").alias("hb")), ["b", "position"])
    return j.groupBy("a", "b").agg(F.count("*").alias("linked"), F.bool_and(F.lower(F.trim("ha")) == F.lower(F.trim("hb"))).alias("agree"))


def masked_duplicates(s: SparkSession, d: str) -> DataFrame:
    """Chunks of a question that are an earlier one's wording but for numbers and case."""
    p = _passages(s, d).select("question_id", "row_id", "content_hash", F.sha2(X.masked_numbers(F.lower("text")), 256).alias("mask"))
    first = p.groupBy("question_id", "mask").agg(F.min("row_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    return p.join(first, ["question_id", "mask"]).filter("row_id > first").select("row_id", "first")


def close_vectors(s: SparkSession, d: str) -> DataFrame:
    """Pairs of embeddings of one label with a cosine of 0.3 or more: blocks of a label against each other, only the pairs that pass leave a block."""
    e = table(s, d, "embeddings").select(F.col("label").alias("g"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return retrieval.pairs_above(e, "g", "id", "vector", 0.3).select("g", "a", "b", F.round("similarity", 6).alias("similarity"))


def merged_settings(s: SparkSession, d: str) -> DataFrame:
    """Settings of a question's pools merged key by key, a later version's winning, as one text; finished ones unchanged."""
    p = table(s, d, "evidence_pools").select("question_id", "pool_version", "web_results_requested", "academic_results_requested").distinct()
    long = p.select("question_id", "pool_version", F.explode(F.create_map(F.lit("academic"), "academic_results_requested", F.lit("web"), "web_results_requested")).alias("k", "v")).filter("v is not null")
    last = long.groupBy("question_id", "k").agg(F.max_by("v", F.struct("pool_version", "v")).alias("v"))
    return last.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: F.concat(x["k"], F.lit("="), x["v"].cast("string"))), ";").alias("settings"))


def source_round_trip(s: SparkSession, d: str) -> DataFrame:
    """Per provider, sources that are the same after a way through JSON text."""
    p = table(s, d, "pool_chunks").select("source")
    micros = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    options = {"timestampFormat": micros, "timestampNTZFormat": micros}
    again = F.from_json(F.to_json("source", {"ignoreNullFields": "false", **options}), p.schema["source"].dataType.json(), options)
    return p.groupBy(F.col("source.provider").alias("provider")).agg(F.count("*").alias("sources"), F.count_if((F.col("source.title").eqNullSafe(again["title"])) & (F.col("source.authors").eqNullSafe(again["authors"])) & (F.col("source.retrieved_at").eqNullSafe(again["retrieved_at"]))).alias("same"))


def optional_depths(s: SparkSession, d: str) -> DataFrame:
    """Papers by depth with counts of those with a DOI and an abstract of over 500 characters: splits of a result."""
    p = table(s, d, "paper_records")
    return p.groupBy(F.when(F.col("abstract").isNotNull(), "abstract").otherwise("metadata").alias("depth")).agg(F.count("*").alias("papers"), F.count("doi").alias("with_doi"), F.count_if(F.length("abstract") > 500).alias("long"))


def traceable_questions(s: SparkSession, d: str) -> DataFrame:
    """Per set, questions of which any passage has both a known source and a chunk id: fully traceable ones."""
    known = table(s, d, "paper_records").select("fingerprint").union(table(s, d, "web_results").select("fingerprint")).distinct().select(F.col("fingerprint").alias("source_fingerprint"), F.lit(True).alias("known"))
    t = _passages(s, d).join(known, "source_fingerprint", "left").groupBy("question_id").agg(F.bool_or(F.coalesce("known", F.lit(False)) & F.col("chunk_id").isNotNull()).alias("traceable"))
    q = table(s, d, "question_items").groupBy("question_id").agg(F.min("set_name").alias("set_name"))
    return q.join(t, "question_id", "left").groupBy("set_name").agg(F.count("*").alias("questions"), F.count_if("traceable").alias("traceable"))


QUERIES = {
    f.__name__: f
    for f in (provider_results, searched_hosts, failed_queries, pool_lookup, configuration_fingerprints, results_per_question, claim_order, evidence_blocks, source_sections, marked_sentences, verification_summary, record_constraints, quote_offsets, passage_relevance, label_agreement, last_attempts, usage_sums, stage_record, metric_maps, worst_by_family, plain_questions, repeated_sections, plan_positions, section_links, masked_duplicates, close_vectors, merged_settings, source_round_trip, optional_depths, traceable_questions)
}

_HOST = "regexp_extract(regexp_replace(lower(regexp_replace(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1), '^.*@', '')), '^www\\.', ''), '^([^:]*)', 1)"
_LABELS = """f AS (SELECT question_id, source_fingerprint, min(row_id) AS first_use, count(*) AS uses FROM pool_chunks WHERE question_id IS NOT NULL AND source_fingerprint IS NOT NULL GROUP BY ALL),
  lab AS (SELECT *, dense_rank() OVER (PARTITION BY question_id ORDER BY first_use, source_fingerprint) AS n FROM f)"""
_HEADS = "h AS (SELECT doc_id, lower(trim(substring(line, 4, 1000))) AS heading FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE contains(text, '## ')) WHERE starts_with(line, '## '))"
_STATEMENTS = "q AS (SELECT DISTINCT question_id, unnest(expected_evidence) AS quote FROM question_items)"
_LONG = "list_distinct(list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda x: length(x) >= 7))"
_OPENING = "(?i)^\\s*(what did|what is|does|do|is it true that|how do|which|why did|can|for|by|to what extent does)\\s+"
_KNOWN = "k AS (SELECT fingerprint FROM paper_records UNION SELECT fingerprint FROM web_results)"

ORACLE = {
    "provider_results": """SELECT provider, count(*) AS results, count(*) FILTER (WHERE coalesce(trim(url), '') = '') AS malformed, count(*) FILTER (WHERE NOT isnan(score) AND (score < 0 OR score > 1)) AS clamped,
      count(*) FILTER (WHERE coalesce(trim(content), '') = '') AS without_text, round(sum(CASE WHEN NOT isnan(score) THEN least(greatest(score, 0), 1) END), 4) AS score FROM web_results GROUP BY 1""",
    "searched_hosts": f"""WITH w AS (SELECT *, {_HOST} AS host FROM web_results WHERE provider IN ('newsgrid', 'webscout') AND query IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY provider, query ORDER BY rank ASC NULLS LAST, web_key) AS n FROM w WHERE host NOT IN ('dailymarrow.test', 'plainfacts.invalid'))
      SELECT provider, count(*) AS results, count(DISTINCT host) AS hosts FROM n WHERE n <= 10 GROUP BY 1""",
    "failed_queries": "WITH w AS (SELECT query, provider, count(content) AS readable FROM web_results WHERE query IS NOT NULL GROUP BY ALL) SELECT query, count(*) AS asked, count(*) FILTER (WHERE readable = 0) AS failed, count(*) FILTER (WHERE readable = 0) = count(*) AS all_failed FROM w GROUP BY 1",
    "pool_lookup": """WITH q AS (SELECT DISTINCT question_id, set_name FROM question_items), p AS (SELECT DISTINCT question_id, pool_version, web_results_requested AS w, academic_results_requested AS a FROM evidence_pools)
      SELECT question_id, set_name, pool_version, CAST(row_number() OVER (PARTITION BY question_id ORDER BY pool_version DESC, set_name) AS INTEGER) AS place FROM p JOIN q USING (question_id) WHERE set_name IN ('validation', 'test') AND w > 0 AND a > 0""",
    "configuration_fingerprints": """WITH p AS (SELECT DISTINCT question_id, pool_version AS v, web_results_requested AS w, academic_results_requested AS a FROM evidence_pools)
      SELECT sha256('{' || concat_ws(',', CASE WHEN a IS NOT NULL THEN '"academic_results_requested":"' || a || '"' END, '"pool_version":' || coalesce('"' || v || '"', 'null'), '"web_results_requested":' || coalesce('"' || w || '"', 'null')) || '}') AS fingerprint, count(*) AS pools FROM p GROUP BY 1""",
    "results_per_question": "SELECT category, count(DISTINCT question_id) AS questions, CAST(greatest(2, ceil(50 / count(DISTINCT question_id))) AS BIGINT) AS results_each FROM question_items WHERE category IS NOT NULL GROUP BY 1",
    "claim_order": """WITH q AS (SELECT category, question_id, bool_or(coalesce(premise_is_false, false)) AS important, max(CAST(difficulty = 'hard' AS INTEGER)) AS core FROM question_items WHERE category IS NOT NULL GROUP BY ALL),
      n AS (SELECT category, question_id, CAST(row_number() OVER (PARTITION BY category ORDER BY important DESC, core DESC NULLS LAST, question_id) - 1 AS INTEGER) AS priority_rank FROM q) SELECT *, CASE WHEN priority_rank < 15 THEN 'verified' ELSE 'claim_cap' END AS outcome FROM n""",
    "evidence_blocks": """WITH b AS (SELECT depth, '[P' || row_id || '] ' || coalesce(nullif(source.title, ''), nullif(source.url, ''), nullif(source.doi, ''), 'untitled source') || ' (' || concat_ws(', ', coalesce(nullif(source.provider, ''), source.source_type), CAST(source.year AS VARCHAR)) || '; evidence: ' || depth || ')' || chr(10) || text AS block FROM pool_chunks WHERE question_id IS NOT NULL)
      SELECT depth, count(*) AS blocks, CAST(sum(length(block)) AS BIGINT) AS characters, min(sha256(block)) AS least_hash FROM b GROUP BY 1""",
    "source_sections": f"WITH {_LABELS} SELECT question_id, string_agg('S' || n || ' x' || uses, '; ' ORDER BY n) AS sources FROM lab GROUP BY 1",
    "marked_sentences": f"""WITH {_LABELS}, c AS (SELECT * FROM pool_chunks WHERE question_id IS NOT NULL AND source_fingerprint IS NOT NULL AND document_id IS NOT NULL AND text IS NOT NULL),
      e AS (SELECT question_id, document_id, regexp_replace(arg_min(right(text, 40), row_id), '[\\s\\x{{00a0}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{3000}}]+$', '') AS t FROM c GROUP BY ALL),
      m AS (SELECT question_id, document_id, string_agg('[S' || n || ']', '' ORDER BY n) AS tags FROM (SELECT DISTINCT question_id, document_id, source_fingerprint FROM c) JOIN lab USING (question_id, source_fingerprint) GROUP BY ALL)
      SELECT question_id, document_id, CASE WHEN right(t, 1) IN ('.', '!', '?') THEN left(t, length(t) - 1) || ' ' || tags || right(t, 1) ELSE t || ' ' || tags END AS line FROM e JOIN m USING (question_id, document_id)""",
    "verification_summary": f"""WITH {_LABELS}, d AS (SELECT question_id, coalesce(document_id, '') AS k, string_agg(CAST(row_id AS VARCHAR), ',' ORDER BY position NULLS FIRST, row_id) AS rows FROM pool_chunks WHERE question_id IS NOT NULL GROUP BY ALL),
      n AS (SELECT question_id, string_agg(k || ':' || rows, ';' ORDER BY k) AS passages FROM d GROUP BY 1), l AS (SELECT question_id, count(*) AS sources FROM lab GROUP BY 1), x AS (SELECT question_id, max(coalesce(len(known_conflicts), 0)) AS conflicts FROM question_items GROUP BY 1)
      SELECT question_id, passages, coalesce(sources, 0) AS sources, CAST(coalesce(conflicts, 0) AS INTEGER) AS conflicts FROM n LEFT JOIN l USING (question_id) LEFT JOIN x USING (question_id)""",
    "record_constraints": """SELECT rule, count(*) AS broken FROM (
      SELECT 'depth_matches_abstract' AS rule FROM paper_records WHERE (abstract IS NOT NULL) <> (length(coalesce(abstract, '')) > 0) UNION ALL SELECT 'influential_within_citations' FROM paper_records WHERE NOT influential_citation_count <= citation_count
      UNION ALL SELECT 'doi_begins_with_10' FROM paper_records WHERE NOT starts_with(lower(doi), '10.') UNION ALL SELECT 'paper_is_identifiable' FROM paper_records WHERE coalesce(doi, url, paper_id) IS NULL
      UNION ALL SELECT 'page_has_an_address' FROM web_results WHERE url IS NULL UNION ALL SELECT 'page_has_no_doi_elsewhere' FROM web_results WHERE doi IS NOT NULL AND NOT contains(url, doi) UNION ALL SELECT 'rank_is_positive' FROM web_results WHERE NOT rank > 0
      UNION ALL SELECT 'pool_asks_something' FROM evidence_pools WHERE NOT web_results_requested + academic_results_requested > 0 UNION ALL SELECT 'pool_has_a_hash' FROM evidence_pools WHERE length(coalesce(content_hash, '')) <> 64
      UNION ALL SELECT unnest(list_filter([CASE WHEN NOT value BETWEEN 0 AND 1 THEN 'share_within_one' END, CASE WHEN NOT n <= d THEN 'part_within_whole' END, CASE WHEN abs(value - n / d) > 0.005 THEN 'value_follows_from_terms' END], lambda x: x IS NOT NULL))
        FROM (SELECT n, d, round(n / d, 1) AS value FROM (SELECT source.provider, count(source.rank) AS n, count(*) AS d FROM pool_chunks GROUP BY 1))) GROUP BY 1""",
    "quote_offsets": """WITH p AS (SELECT row_id, text, start_char, substring(text, CAST(floor(length(text) / 2) AS INTEGER), 40) AS quote FROM pool_chunks WHERE question_id IS NOT NULL AND length(text) > 0)
      SELECT row_id, CAST(strpos(text, quote) - 1 AS INTEGER) AS quote_start, CAST(strpos(text, quote) - 1 + length(quote) AS INTEGER) AS quote_end, CAST(start_char + strpos(text, quote) - 1 AS INTEGER) AS document_start, true AS agrees FROM p WHERE length(quote) > 0""",
    "passage_relevance": f"""WITH {_STATEMENTS}, w AS (SELECT question_id, quote, {_LONG.format('quote')} AS wanted FROM q), p AS (SELECT question_id, row_id, {_LONG.format('text')} AS words FROM pool_chunks WHERE question_id IS NOT NULL),
      h AS (SELECT p.question_id, row_id, quote FROM p JOIN w ON p.question_id = w.question_id AND len(list_intersect(words, wanted)) * 2 >= len(wanted))
      SELECT p.question_id, count(*) AS passages, count(*) FILTER (WHERE row_id IN (SELECT row_id FROM h)) AS relevant, CAST(coalesce(any_value(n), 0) AS INTEGER) AS covered FROM p LEFT JOIN (SELECT question_id, count(DISTINCT quote) AS n FROM h GROUP BY 1) x USING (question_id) GROUP BY 1""",
    "label_agreement": """WITH q AS (SELECT set_name, category, difficulty, regexp_extract(question_id, '^[a-z]+-(.+)-\\d+$', 1) AS e FROM question_items WHERE category IS NOT NULL) SELECT set_name, count(*) AS items, round(count(*) FILTER (WHERE category = e OR (difficulty = 'hard' AND category = 'false_premise')) / count(*), 4) AS agreement FROM q GROUP BY 1""",
    "last_attempts": "WITH e AS (SELECT user_id, arg_max(event_type, {'ts': ts, 'id': event_id}) AS reason, count(*) AS attempts FROM events GROUP BY 1) SELECT reason, count(*) AS users, max(attempts) AS most_attempts FROM e GROUP BY 1",
    "usage_sums": "WITH e AS (SELECT event_type, unnest(json_keys(props)) AS key, props FROM events) SELECT event_type, key, CAST(sum(CAST(json_extract_string(props, '$.' || key) AS BIGINT)) AS BIGINT) AS total, count(*) AS events FROM e GROUP BY ALL",
    "stage_record": "WITH e AS (SELECT user_id, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY ALL) SELECT user_id, string_agg(concat_ws(':', event_type, n, cents), ',' ORDER BY event_type) AS stages, CAST(sum(cents) AS BIGINT) AS cents FROM e GROUP BY 1",
    "metric_maps": "SELECT source.provider AS provider, CAST(3 + CASE WHEN max(source.rank) IS NULL THEN 0 ELSE 1 END AS INTEGER) AS metrics, CAST(count(*) AS DOUBLE) AS chunks, CAST(max(source.rank) AS DOUBLE) AS deepest FROM pool_chunks GROUP BY 1",
    "worst_by_family": "SELECT string_split(p_type, ' ')[1] AS family, max(p_retailprice) AS price, max(p_size) AS size, count(*) AS parts FROM part GROUP BY 1",
    "plain_questions": f"WITH q AS (SELECT DISTINCT question_id, question FROM question_items WHERE question IS NOT NULL) SELECT lower(regexp_extract(question, '{_OPENING}', 1)) AS opening, count(*) AS questions, min(sha256(regexp_replace(question, '{_OPENING}', ''))) AS least_hash FROM q GROUP BY 1",
    "repeated_sections": f"""WITH {_HEADS}, r AS (SELECT doc_id, heading FROM h GROUP BY ALL HAVING count(*) > 1) SELECT heading, 'repeated' AS issue, count(*) AS documents FROM r GROUP BY 1
      UNION ALL SELECT heading, 'missing', (SELECT count(DISTINCT doc_id) FROM h) - count(DISTINCT doc_id) FROM h GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5""",
    "plan_positions": """WITH q AS (SELECT category, question_id, min(created) AS created FROM question_items WHERE category IS NOT NULL GROUP BY ALL) SELECT category, question_id, CAST(row_number() OVER o - 1 AS INTEGER) AS position, lag(created) OVER o = created AS same_date FROM q WINDOW o AS (PARTITION BY category ORDER BY created NULLS LAST, question_id)""",
    "section_links": """WITH t AS (SELECT question_id, min(doc_id) AS a, max(doc_id) AS b FROM documents WHERE question_id IS NOT NULL AND contains(text, '## ') GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
      s AS (SELECT doc_id, substring(line, 4, 1000) AS heading, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS p FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE contains(text, '## ')) WHERE starts_with(line, '## '))
      SELECT a, b, count(*) AS linked, bool_and(lower(trim(x.heading)) = lower(trim(y.heading))) AS agree FROM t JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND y.p = x.p GROUP BY ALL""",
    "masked_duplicates": """WITH p AS (SELECT question_id, row_id, sha256(regexp_replace(lower(text), '\\d+(?:[.,]\\d+)*', '#', 'g')) AS mask FROM pool_chunks WHERE question_id IS NOT NULL), f AS (SELECT *, min(row_id) OVER (PARTITION BY question_id, mask) AS first FROM p WHERE mask IS NOT NULL) SELECT row_id, first FROM f WHERE row_id > first""",
    "close_vectors": """SELECT x.label AS g, x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id < y.vec_id WHERE list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) >= 0.3""",
    "merged_settings": """WITH p AS (SELECT DISTINCT question_id, pool_version, web_results_requested AS web, academic_results_requested AS academic FROM evidence_pools), l AS (SELECT question_id, pool_version, 'web' AS k, web AS v FROM p UNION ALL SELECT question_id, pool_version, 'academic', academic FROM p),
      m AS (SELECT question_id, k, arg_max(v, {'p': pool_version, 'v': v}) AS v FROM l WHERE v IS NOT NULL GROUP BY ALL) SELECT question_id, string_agg(k || '=' || v, ';' ORDER BY k) AS settings FROM m GROUP BY 1""",
    "source_round_trip": "SELECT source.provider AS provider, count(*) AS sources, count(*) AS same FROM pool_chunks GROUP BY 1",
    "optional_depths": "SELECT CASE WHEN abstract IS NOT NULL THEN 'abstract' ELSE 'metadata' END AS depth, count(*) AS papers, count(doi) AS with_doi, count(*) FILTER (WHERE length(abstract) > 500) AS long FROM paper_records GROUP BY 1",
    "traceable_questions": f"""WITH {_KNOWN}, t AS (SELECT question_id, bool_or(source_fingerprint IN (SELECT fingerprint FROM k WHERE fingerprint IS NOT NULL) AND chunk_id IS NOT NULL) AS traceable FROM pool_chunks WHERE question_id IS NOT NULL GROUP BY 1), q AS (SELECT question_id, min(set_name) AS set_name FROM question_items GROUP BY 1)
      SELECT set_name, count(*) AS questions, count(*) FILTER (WHERE traceable) AS traceable FROM q LEFT JOIN t USING (question_id) GROUP BY 1""",
}
