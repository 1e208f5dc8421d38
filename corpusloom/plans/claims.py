"""Claims, verdicts and citations: rates, audits, comparisons, verification rules.

Bindings: a chunk of a pool is a claim of its question's report, judged by its
relevance score (0.6 supported, 0.45 partially, 0.3 not enough evidence, 0.2
unsupported, below contradicted; no score, not judged); a score of 0.6 states
support, one below 0.2 contradiction. The quotation of a ranked chunk is cut from
its text, that of an unranked one is its source's title. Its source is its
citation, valid where the source is known and the claim supported. Providers are arms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import metrics as M
from corpusloom.operators import verdicts as V
from corpusloom.sources.tables import table

ARMS = ("webscout", "newsgrid", "scholarnet", "medindex")
#: Which way a figure is better.
BETTER = {"support_rate": "higher", "unsupported_rate": "lower", "citation_precision": "higher"}


def _claims(s: SparkSession, d: str) -> DataFrame:
    score = F.col("source.relevance_score")
    c = table(s, d, "pool_chunks").filter("question_id is not null").select(
        "row_id", "question_id", F.col("source.provider").alias("arm"), F.col("source_fingerprint").alias("fp"), "document_id", "depth", "text", F.when(~F.isnan(score), score).alias("s"), F.col("source.rank").alias("rank"),
        F.when(F.col("source.rank").isNull(), F.col("source.title")).otherwise(F.substring("text", 11, 30)).alias("quote"),
    )
    s_ = F.col("s")
    verdict = F.when(s_ >= 0.6, "supported").when(s_ >= 0.45, "partially_supported").when(s_ >= 0.3, "not_enough_evidence").when(s_ >= 0.2, "unsupported").when(s_ < 0.2, "contradicted")
    stated = F.when(s_ >= 0.6, "supports").when(s_ < 0.2, "contradicts").otherwise("neutral")
    return c.withColumn("verdict", verdict).withColumn("stated", stated).withColumn("requires", F.col("depth") != "metadata")


def _cited(s: SparkSession, d: str) -> DataFrame:
    known = table(s, d, "paper_records").select("fingerprint").union(table(s, d, "web_results").select("fingerprint")).distinct().select(F.col("fingerprint").alias("fp"), F.lit(True).alias("known"))
    j = _claims(s, d).drop("text", "quote").join(known, "fp", "left")
    status = F.when(F.col("known").isNull(), "fabricated").when(F.col("verdict").isNull(), "unvalidated").when(F.col("verdict").isin("supported", "partially_supported"), "valid").otherwise("misattributed")
    return j.withColumn("status", status)


def verdict_counts(s: SparkSession, d: str) -> DataFrame:
    """Claims per arm and verdict; those not judged count as failures of their own."""
    return _claims(s, d).groupBy("arm", F.coalesce("verdict", F.lit("(failed)")).alias("verdict")).agg(F.count("*").alias("claims"))


def claim_rates(s: SparkSession, d: str) -> DataFrame:
    """Per arm: claims, those requiring a citation, rates of support, of no support, of contradiction among the judged, and of hallucination."""
    v = F.col("verdict")
    return _claims(s, d).groupBy("arm").agg(
        F.count("*").alias("claims"), F.count_if("requires").alias("requiring"), M.rate(v.isin("supported", "partially_supported"), v.isNotNull()).alias("support_rate"),
        M.unsupported_rate(v).alias("unsupported_rate"), M.rate(v == "contradicted", v.isNotNull()).alias("contradiction_rate"), F.count_if(M.is_hallucination(v)).alias("hallucinations"),
    )


def citation_rates(s: SparkSession, d: str) -> DataFrame:
    """Per arm: precision of judged citations, coverage of the claims that require one."""
    st = F.col("status")
    return _cited(s, d).groupBy("arm").agg(M.rate(st == "valid", st != "unvalidated").alias("citation_precision"), M.rate(st == "valid", F.col("requires")).alias("citation_coverage"), F.count_if(st == "fabricated").alias("fabricated"))


def conflict_detection(s: SparkSession, d: str) -> DataFrame:
    """Per category: questions with known conflicts whose pool both supports and contradicts."""
    q = table(s, d, "question_items").filter("size(known_conflicts) > 0").groupBy("question_id").agg(F.min("category").alias("category"))
    both = _claims(s, d).groupBy("question_id").agg((F.bool_or(F.col("stated") == "supports") & F.bool_or(F.col("stated") == "contradicts")).alias("both"))
    j = q.join(both, "question_id", "left")
    return j.groupBy("category").agg(F.count("*").alias("expected"), F.count_if("both").alias("detected"), M.rate(F.coalesce("both", F.lit(False))).alias("conflict_detection_rate"))


def report_audit(s: SparkSession, d: str) -> DataFrame:
    """Per report: claims, citations by status, share of claims cited and share of citations valid, three places."""
    st = F.col("status")
    counts = [F.count_if(st == name).alias(name) for name in ("valid", "misattributed", "fabricated", "unvalidated")]
    g = _cited(s, d).groupBy("question_id").agg(F.count("*").alias("claims"), F.count_if("requires").alias("requiring"), F.count_if(F.col("requires") & F.col("fp").isNotNull()).alias("cited"), *counts)
    return g.withColumn("coverage", M.ratio(F.col("cited"), F.col("requiring"), 3)).withColumn("validity", M.ratio(F.col("valid"), F.col("valid") + F.col("misattributed") + F.col("fabricated"), 3))


def arm_aggregate(s: SparkSession, d: str) -> DataFrame:
    """Per arm: cells completed and failed, failure rate, mean support rate over cells that have one and how many, and share with a conflict."""
    v = F.col("verdict")
    cell = _claims(s, d).groupBy("arm", "question_id").agg(F.count("verdict").alias("judged"), M.rate(v.isin("supported", "partially_supported"), v.isNotNull()).alias("rate"), (F.bool_or(F.col("stated") == "supports") & F.bool_or(F.col("stated") == "contradicts")).alias("conflict"))
    return cell.groupBy("arm").agg(
        F.count_if(F.col("judged") > 0).alias("completed"), F.count_if(F.col("judged") == 0).alias("failed"), M.rate(F.col("judged") == 0).alias("failure_rate"),
        F.round(F.avg("rate"), 4).alias("mean_support"), F.count("rate").alias("n"), M.rate(F.col("conflict"), F.col("judged") > 0).alias("conflict_rate"),
    )


def arm_comparison(s: SparkSession, d: str) -> DataFrame:
    """webscout against newsgrid, figure by figure: both values, absolute and relative difference, and the direction by which way is better."""
    wide = claim_rates(s, d).join(citation_rates(s, d), "arm").filter(F.col("arm").isin("webscout", "newsgrid"))
    long = wide.unpivot(["arm"], list(BETTER), "metric", "value")
    g = long.groupBy("metric").agg(F.max(F.when(F.col("arm") == "webscout", F.col("value"))).alias("a"), F.max(F.when(F.col("arm") == "newsgrid", F.col("value"))).alias("b"))
    return M.compared(g, "a", "b", BETTER)


def comparison_lines(s: SparkSession, d: str) -> DataFrame:
    """The comparison as lines of text, a dash for what is unknown."""
    shown = lambda c: F.coalesce(F.format_string("%.4f", F.col(c)), F.lit("—"))
    return arm_comparison(s, d).select("metric", F.concat_ws(" | ", "metric", shown("a"), shown("b"), shown("difference"), F.coalesce("direction", F.lit("—"))).alias("line"))


def enforced_relations(s: SparkSession, d: str) -> DataFrame:
    """Stated against enforced relations: without a word-for-word quotation a passage is neutral."""
    c = _claims(s, d)
    return c.groupBy("stated", V.enforced_relation(F.col("stated"), F.col("text"), F.col("quote")).alias("enforced")).agg(F.count("*").alias("passages"))


def _anchors(s: SparkSession, d: str) -> DataFrame:
    c = _claims(s, d)
    r = c.select("question_id", "row_id", "s", "verdict", V.enforced_relation(F.col("stated"), F.col("text"), F.col("quote")).alias("relation"))
    top = r.groupBy("question_id").agg(F.max_by("verdict", F.struct("s", "row_id")).alias("verdict"))
    return V.anchored(r.drop("verdict").join(top, "question_id"), "question_id", "verdict", "relation", "row_id", "row_id")


def verdict_anchors(s: SparkSession, d: str) -> DataFrame:
    """Per question the verdict of its best chunk, the passage it rests on, and the verdict left without one."""
    verdict, back = V.downgraded(F.col("verdict"), F.col("anchor"))
    return _anchors(s, d).select("question_id", "verdict", "anchor", verdict.alias("final_verdict"), back.alias("downgraded"))


def checked_conflicts(s: SparkSession, d: str) -> DataFrame:
    """Per question a conflict of its first supporting and first contradicting passage, kept where both quotations stand; with both sources."""
    c = _claims(s, d).select("question_id", "row_id", "fp", V.enforced_relation(F.col("stated"), F.col("text"), F.col("quote")).alias("relation"))
    pair = c.groupBy("question_id").agg(*[F.min(F.when(F.col("relation") == r, F.col("row_id"))).alias(n) for r, n in (("supports", "a"), ("contradicts", "b"))]).filter("a is not null and b is not null")
    side = lambda n: c.select(F.col("row_id").alias(n), F.col("fp").alias(f"source_{n}"))
    return pair.join(side("a"), "a").join(side("b"), "b").select("question_id", "a", "b", "source_a", "source_b")


def citation_assessments(s: SparkSession, d: str) -> DataFrame:
    """Per report and document, the assessment of its citations."""
    st = F.col("status")
    g = _cited(s, d).groupBy("question_id", "document_id").agg(
        F.coalesce(F.bool_or(F.col("stated") == "supports") & F.bool_or(F.col("stated") == "contradicts"), F.lit(False)).alias("conflict"), F.bool_or("requires").alias("required"),
        F.count_if(F.col("fp").isNotNull()).alias("citations"), F.count_if(st == "valid").alias("valid"), F.max_by("verdict", F.struct("s", "row_id")).alias("verdict"),
    )
    a = V.citation_assessment(F.col("conflict"), F.coalesce("required", F.lit(False)), F.col("citations"), F.col("valid"), F.coalesce("verdict", F.lit("")))
    return g.groupBy(a.alias("assessment")).agg(F.count("*").alias("claims"))


def claim_statuses(s: SparkSession, d: str) -> DataFrame:
    """Statuses of questions by pool verdict and passage outcomes, with their placement; questions with a false premise are important."""
    c = _claims(s, d)
    rel = V.enforced_relation(F.col("stated"), F.col("text"), F.col("quote"))
    out = c.select("question_id", "row_id", "s", "verdict", V.passage_outcome(rel, F.coalesce("verdict", F.lit(""))).alias("outcome"))
    g = out.groupBy("question_id").agg(F.max_by("verdict", F.struct("s", "row_id")).alias("pool"), F.array_sort(F.collect_set("outcome")).alias("outcomes"))
    important = table(s, d, "question_items").groupBy("question_id").agg(F.max(F.coalesce("premise_is_false", F.lit(False))).alias("important"))
    j = g.join(important, "question_id").withColumn("status", V.claim_status(F.col("pool"), F.col("outcomes")))
    placed = V.placement(F.col("status"), F.coalesce(F.col("pool") == "partially_supported", F.lit(False)), F.col("important"))
    return j.groupBy("status", placed.alias("placement")).agg(F.count("*").alias("questions"))


def category_caution(s: SparkSession, d: str) -> DataFrame:
    """Per category the most cautious status of its questions, and questions by status as one line."""
    c = _claims(s, d)
    out = c.select("question_id", "row_id", "s", "verdict", V.passage_outcome(F.col("stated"), F.coalesce("verdict", F.lit(""))).alias("outcome"))
    g = out.groupBy("question_id").agg(F.max_by("verdict", F.struct("s", "row_id")).alias("pool"), F.collect_set("outcome").alias("outcomes")).withColumn("status", V.claim_status(F.col("pool"), F.col("outcomes")))
    q = table(s, d, "question_items").filter("category is not null").groupBy("question_id").agg(F.min("category").alias("category"))
    each = g.join(q, "question_id").groupBy("category", "status").agg(F.count("*").alias("n"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("status", "n"))), lambda x: F.concat(x["status"], F.lit("="), x["n"].cast("string"))), "; ")
    return each.groupBy("category").agg(V.most_cautious(F.col("status")).alias("cautious"), line.alias("statuses"))


def evaluation_cells(s: SparkSession, d: str) -> DataFrame:
    """Every question and arm of the held-out sets: missing, unavailable, no claims, error or judged."""
    q = table(s, d, "question_items").filter("set_name <> 'development'").select("question_id").distinct()
    cells = q.withColumn("arm", F.explode(F.array(*[F.lit(a) for a in ARMS])))
    pools = table(s, d, "evidence_pools").select("question_id", F.lit(True).alias("pool")).distinct()
    c = _claims(s, d).groupBy("question_id", "arm").agg(F.count("*").alias("rows"), F.count_if("requires").alias("claims"), F.count("verdict").alias("judged"))
    j = cells.join(pools, "question_id", "left").join(c, ["question_id", "arm"], "left").fillna(0, ["rows", "claims", "judged"])
    status = V.cell_status(F.col("pool").isNotNull(), F.col("rows") > 0, F.col("claims"), F.col("judged"))
    return j.groupBy("arm", status.alias("status")).agg(F.count("*").alias("cells"))


def rogue_sources(s: SparkSession, d: str) -> DataFrame:
    """Per question, sources it cites that no provider knows, and chunk ids of other questions under its documents."""
    emitted = table(s, d, "pool_chunks").filter("question_id is not null").groupBy("question_id").agg(F.collect_set("source_fingerprint").alias("emitted"))
    j = table(s, d, "pool_chunks").filter("question_id is not null").select("question_id", "source_fingerprint").distinct()
    known = table(s, d, "paper_records").select("fingerprint").union(table(s, d, "web_results").select("fingerprint")).distinct()
    valid = j.join(known, j["source_fingerprint"] == known["fingerprint"], "left_semi").groupBy("question_id").agg(F.collect_set("source_fingerprint").alias("valid"))
    rogue = F.array_except("emitted", F.coalesce("valid", F.array().cast("array<string>")))
    return emitted.join(valid, "question_id", "left").select("question_id", F.size("emitted").alias("emitted"), F.size(rogue).alias("rogue"))


def chunk_unions(s: SparkSession, d: str) -> DataFrame:
    """Per set and origin, the distinct chunks behind all its questions: the union of their chunk sets."""
    q = table(s, d, "question_items").groupBy("question_id").agg(F.min("set_name").alias("set_name"), F.min("origin").alias("origin"))
    c = table(s, d, "pool_chunks").filter("question_id is not null").select("question_id", "chunk_id").distinct()
    return c.join(q, "question_id").groupBy("set_name", "origin").agg(F.countDistinct("chunk_id").alias("chunks"), F.countDistinct("question_id").alias("questions"))


def reused_chunks(s: SparkSession, d: str) -> DataFrame:
    """Chunk ids that pools name but that stand under another document than their row's first: the missing side of the set."""
    c = table(s, d, "pool_chunks").filter("chunk_id is not null")
    first = c.groupBy("chunk_id").agg(F.min_by("document_id", "row_id").alias("document_id"), F.count("*").alias("deliveries"))
    docs = table(s, d, "documents").select(F.col("doc_id").cast("string").alias("document_id")).distinct()
    return first.join(docs, "document_id", "left_anti").groupBy("deliveries").agg(F.count("*").alias("missing"))


def comparable_arms(s: SparkSession, d: str) -> DataFrame:
    """Per category, whether all arms have as many questions: an unbalanced comparison is none."""
    q = table(s, d, "question_items").filter("category is not null").groupBy("question_id").agg(F.min("category").alias("category"))
    r = _claims(s, d).filter(F.col("arm").isin(*ARMS)).join(q, "question_id").groupBy("category", "arm").agg(F.countDistinct("question_id").alias("runs"))
    return r.groupBy("category").agg(F.min("runs").alias("fewest"), F.max("runs").alias("most"), (F.countDistinct("runs") == 1).alias("comparable"))


QUERIES = {
    f.__name__: f
    for f in (verdict_counts, claim_rates, citation_rates, conflict_detection, report_audit, arm_aggregate, arm_comparison, comparison_lines, enforced_relations, verdict_anchors, checked_conflicts, citation_assessments, claim_statuses, category_caution, evaluation_cells, rogue_sources, chunk_unions, reused_chunks, comparable_arms)
}

_C = """c AS (SELECT row_id, question_id, source.provider AS arm, source_fingerprint AS fp, document_id, depth, text, CASE WHEN NOT isnan(source.relevance_score) THEN source.relevance_score END AS s,
    CASE WHEN source.rank IS NULL THEN source.title ELSE substring(text, 11, 30) END AS quote FROM pool_chunks WHERE question_id IS NOT NULL),
  v AS (SELECT *, CASE WHEN s >= 0.6 THEN 'supported' WHEN s >= 0.45 THEN 'partially_supported' WHEN s >= 0.3 THEN 'not_enough_evidence' WHEN s >= 0.2 THEN 'unsupported' WHEN s < 0.2 THEN 'contradicted' END AS verdict,
    CASE WHEN s >= 0.6 THEN 'supports' WHEN s < 0.2 THEN 'contradicts' ELSE 'neutral' END AS stated, depth <> 'metadata' AS requires FROM c),
  e AS (SELECT *, CASE WHEN length(quote) > 0 AND contains(text, quote) THEN stated ELSE 'neutral' END AS relation FROM v)"""
_K = """k AS (SELECT DISTINCT fingerprint FROM (SELECT fingerprint FROM paper_records UNION ALL SELECT fingerprint FROM web_results)),
  t AS (SELECT v.*, CASE WHEN k.fingerprint IS NULL THEN 'fabricated' WHEN verdict IS NULL THEN 'unvalidated' WHEN verdict IN ('supported', 'partially_supported') THEN 'valid' ELSE 'misattributed' END AS status FROM v LEFT JOIN k ON v.fp = k.fingerprint)"""
_SUP = "count(*) FILTER (WHERE verdict IN ('supported', 'partially_supported'))"
_RATES = f"""r AS (SELECT arm, count(*) AS claims, count(*) FILTER (WHERE requires) AS requiring, round({_SUP} / nullif(count(verdict), 0), 4) AS support_rate, round(count(*) FILTER (WHERE verdict IN ('unsupported', 'contradicted')) / count(*), 4) AS unsupported_rate,
    round(count(*) FILTER (WHERE verdict = 'contradicted') / nullif(count(verdict), 0), 4) AS contradiction_rate, count(*) FILTER (WHERE verdict IN ('unsupported', 'contradicted')) AS hallucinations FROM v GROUP BY arm)"""
_CITES = "z AS (SELECT arm, round(count(*) FILTER (WHERE status = 'valid') / nullif(count(*) FILTER (WHERE status <> 'unvalidated'), 0), 4) AS citation_precision, round(count(*) FILTER (WHERE status = 'valid' AND requires) / nullif(count(*) FILTER (WHERE requires), 0), 4) AS citation_coverage, count(*) FILTER (WHERE status = 'fabricated') AS fabricated FROM t GROUP BY arm)"
_CMP = f"""l AS (SELECT * FROM r JOIN z USING (arm)), m AS (SELECT 'support_rate' AS metric, arm, support_rate AS value FROM l UNION ALL SELECT 'unsupported_rate', arm, unsupported_rate FROM l UNION ALL SELECT 'citation_precision', arm, citation_precision FROM l),
  g AS (SELECT metric, max(value) FILTER (WHERE arm = 'webscout') AS a, max(value) FILTER (WHERE arm = 'newsgrid') AS b FROM m GROUP BY metric),
  x AS (SELECT metric, a, b, round(a - b, 4) AS difference, round((a - b) / nullif(b, 0), 4) AS relative, CASE WHEN round(a - b, 4) = 0 THEN 'equal' WHEN (a > b) = (metric <> 'unsupported_rate') THEN 'better' WHEN a IS NOT NULL AND b IS NOT NULL THEN 'worse' END AS direction FROM g)"""
_OUT = """CASE WHEN {r} = 'supports' AND verdict = 'supported' THEN 'supports' WHEN {r} = 'supports' AND verdict = 'partially_supported' THEN 'partially_supports' WHEN {r} = 'contradicts' AND verdict IN ('contradicted', 'partially_supported') THEN 'contradicts' ELSE 'does_not_establish' END"""
_TOP = "arg_max(verdict, {'s': coalesce(s, -1e9), 'row_id': row_id})"
_STATUS = """CASE WHEN pool IS NULL THEN 'not_evaluated' WHEN pool = 'contradicted' OR con THEN 'contested' WHEN pool IN ('unsupported', 'not_enough_evidence') THEN 'insufficient_evidence' WHEN sup THEN 'supported_by_cited_source' ELSE 'citation_not_confirmed' END"""

ORACLE = {
    "verdict_counts": f"WITH {_C} SELECT arm, coalesce(verdict, '(failed)') AS verdict, count(*) AS claims FROM v GROUP BY ALL",
    "claim_rates": f"WITH {_C}, {_RATES} SELECT * FROM r",
    "citation_rates": f"WITH {_C}, {_K}, {_CITES} SELECT * FROM z",
    "conflict_detection": f"""WITH {_C}, q AS (SELECT question_id, min(category) AS category FROM question_items WHERE len(known_conflicts) > 0 GROUP BY 1), b AS (SELECT question_id, bool_or(stated = 'supports') AND bool_or(stated = 'contradicts') AS b FROM v GROUP BY 1)
      SELECT category, count(*) AS expected, count(*) FILTER (WHERE b) AS detected, round(count(*) FILTER (WHERE b) / count(*), 4) AS conflict_detection_rate FROM q LEFT JOIN b USING (question_id) GROUP BY 1""",
    "report_audit": f"""WITH {_C}, {_K}, g AS (SELECT question_id, count(*) AS claims, count(*) FILTER (WHERE requires) AS requiring, count(*) FILTER (WHERE requires AND fp IS NOT NULL) AS cited, {', '.join(f"count(*) FILTER (WHERE status = '{n}') AS {n}" for n in ('valid', 'misattributed', 'fabricated', 'unvalidated'))} FROM t GROUP BY 1)
      SELECT *, round(cited / nullif(requiring, 0), 3) AS coverage, round(valid / nullif(valid + misattributed + fabricated, 0), 3) AS validity FROM g""",
    "arm_aggregate": f"""WITH {_C}, cell AS (SELECT arm, question_id, count(verdict) AS judged, round({_SUP} / nullif(count(verdict), 0), 4) AS rate, bool_or(stated = 'supports') AND bool_or(stated = 'contradicts') AS conflict FROM v GROUP BY ALL)
      SELECT arm, count(*) FILTER (WHERE judged > 0) AS completed, count(*) FILTER (WHERE judged = 0) AS failed, round(count(*) FILTER (WHERE judged = 0) / count(*), 4) AS failure_rate, round(avg(rate), 4) AS mean_support, count(rate) AS n,
        round(count(*) FILTER (WHERE conflict AND judged > 0) / nullif(count(*) FILTER (WHERE judged > 0), 0), 4) AS conflict_rate FROM cell GROUP BY arm""",
    "arm_comparison": f"WITH {_C}, {_K}, {_RATES}, {_CITES}, {_CMP} SELECT * FROM x",
    "comparison_lines": f"WITH {_C}, {_K}, {_RATES}, {_CITES}, {_CMP} SELECT metric, concat_ws(' | ', metric, coalesce(printf('%.4f', a), '—'), coalesce(printf('%.4f', b), '—'), coalesce(printf('%.4f', difference), '—'), coalesce(direction, '—')) AS line FROM x",
    "enforced_relations": f"WITH {_C} SELECT stated, relation AS enforced, count(*) AS passages FROM e GROUP BY ALL",
    "verdict_anchors": f"""WITH {_C}, p AS (SELECT question_id, {_TOP} AS verdict FROM e GROUP BY 1),
      a AS (SELECT question_id, min(row_id) FILTER (WHERE relation = 'supports') AS sup, min(row_id) FILTER (WHERE relation = 'contradicts') AS con FROM e GROUP BY 1),
      x AS (SELECT question_id, verdict, CASE verdict WHEN 'supported' THEN sup WHEN 'partially_supported' THEN coalesce(sup, con) WHEN 'contradicted' THEN con END AS anchor FROM p JOIN a USING (question_id)),
      y AS (SELECT *, coalesce(verdict IN ('supported', 'partially_supported', 'contradicted') AND anchor IS NULL, false) AS downgraded FROM x) SELECT question_id, verdict, anchor, CASE WHEN downgraded THEN 'not_enough_evidence' ELSE verdict END AS final_verdict, downgraded FROM y""",
    "checked_conflicts": f"""WITH {_C}, p AS (SELECT question_id, min(row_id) FILTER (WHERE relation = 'supports') AS a, min(row_id) FILTER (WHERE relation = 'contradicts') AS b FROM e GROUP BY 1)
      SELECT p.question_id, a, b, x.fp AS source_a, y.fp AS source_b FROM p JOIN c x ON x.row_id = a JOIN c y ON y.row_id = b""",
    "citation_assessments": f"""WITH {_C}, {_K}, g AS (SELECT question_id, document_id, coalesce(bool_or(stated = 'supports') AND bool_or(stated = 'contradicts'), false) AS conflict, coalesce(bool_or(requires), false) AS required, count(fp) AS citations, count(*) FILTER (WHERE status = 'valid') AS valid, {_TOP} AS verdict FROM t GROUP BY ALL)
      SELECT CASE WHEN conflict THEN 'conflicting' WHEN NOT required THEN 'not_required' WHEN citations = 0 THEN 'missing' WHEN valid = 0 THEN 'invalid' WHEN verdict = 'partially_supported' OR valid < citations THEN 'partially_valid' ELSE 'valid' END AS assessment, count(*) AS claims FROM g GROUP BY 1""",
    "claim_statuses": f"""WITH {_C}, o AS (SELECT question_id, row_id, s, verdict, {_OUT.format(r='relation')} AS outcome FROM e), g AS (SELECT question_id, {_TOP} AS pool, bool_or(outcome = 'contradicts') AS con, bool_or(outcome IN ('supports', 'partially_supports')) AS sup FROM o GROUP BY 1),
      i AS (SELECT question_id, bool_or(coalesce(premise_is_false, false)) AS important FROM question_items GROUP BY 1), x AS (SELECT *, {_STATUS} AS status FROM g JOIN i USING (question_id))
      SELECT status, CASE WHEN status = 'supported_by_cited_source' THEN CASE WHEN coalesce(pool = 'partially_supported', false) THEN 'qualified' ELSE 'body' END WHEN status IN ('citation_not_confirmed', 'contested') THEN status WHEN status = 'insufficient_evidence' THEN CASE WHEN important THEN 'unresolved' ELSE 'unverified_list' END ELSE 'not_evaluated' END AS placement, count(*) AS questions FROM x GROUP BY ALL""",
    "category_caution": f"""WITH {_C}, o AS (SELECT question_id, row_id, s, verdict, {_OUT.format(r='stated')} AS outcome FROM v), g AS (SELECT question_id, {_TOP} AS pool, bool_or(outcome = 'contradicts') AS con, bool_or(outcome IN ('supports', 'partially_supports')) AS sup FROM o GROUP BY 1),
      q AS (SELECT question_id, min(category) AS category FROM question_items WHERE category IS NOT NULL GROUP BY 1), n AS (SELECT category, {_STATUS} AS status, count(*) AS n FROM g JOIN q USING (question_id) GROUP BY ALL)
      SELECT category, arg_min(status, list_position(['not_evaluated', 'contested', 'insufficient_evidence', 'citation_not_confirmed', 'supported_by_cited_source'], status)) AS cautious, string_agg(status || '=' || n, '; ' ORDER BY status) AS statuses FROM n GROUP BY 1""",
    "evaluation_cells": f"""WITH {_C}, cells AS (SELECT question_id, unnest(['webscout', 'newsgrid', 'scholarnet', 'medindex']) AS arm FROM (SELECT DISTINCT question_id FROM question_items WHERE set_name <> 'development')), p AS (SELECT DISTINCT question_id, true AS pool FROM evidence_pools),
      g AS (SELECT question_id, arm, count(*) AS n, count(*) FILTER (WHERE requires) AS claims, count(verdict) AS judged FROM v GROUP BY ALL)
      SELECT arm, CASE WHEN pool IS NULL THEN 'missing' WHEN coalesce(n, 0) = 0 THEN 'unavailable' WHEN claims = 0 THEN 'no_claims' WHEN judged = 0 THEN 'error' ELSE 'judged' END AS status, count(*) AS cells FROM cells LEFT JOIN p USING (question_id) LEFT JOIN g USING (question_id, arm) GROUP BY ALL""",
    "rogue_sources": """WITH c AS (SELECT DISTINCT question_id, source_fingerprint AS f FROM pool_chunks WHERE question_id IS NOT NULL AND source_fingerprint IS NOT NULL), k AS (SELECT fingerprint AS f FROM paper_records UNION SELECT fingerprint FROM web_results)
      SELECT question_id, CAST(count(*) AS INTEGER) AS emitted, CAST(count(*) FILTER (WHERE f NOT IN (SELECT f FROM k WHERE f IS NOT NULL)) AS INTEGER) AS rogue FROM c GROUP BY 1""",
    "chunk_unions": """WITH q AS (SELECT question_id, min(set_name) AS set_name, min(origin) AS origin FROM question_items GROUP BY 1) SELECT set_name, origin, count(DISTINCT chunk_id) AS chunks, count(DISTINCT question_id) AS questions FROM pool_chunks JOIN q USING (question_id) GROUP BY ALL""",
    "reused_chunks": """WITH f AS (SELECT chunk_id, arg_min(document_id, row_id) AS document_id, count(*) AS deliveries FROM pool_chunks WHERE chunk_id IS NOT NULL GROUP BY 1) SELECT deliveries, count(*) AS missing FROM f WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE CAST(d.doc_id AS VARCHAR) = f.document_id) GROUP BY 1""",
    "comparable_arms": f"""WITH {_C}, q AS (SELECT question_id, min(category) AS category FROM question_items WHERE category IS NOT NULL GROUP BY 1), r AS (SELECT category, arm, count(DISTINCT question_id) AS runs FROM v JOIN q USING (question_id) WHERE arm IN ('webscout', 'newsgrid', 'scholarnet', 'medindex') GROUP BY ALL)
      SELECT category, min(runs) AS fewest, max(runs) AS most, count(DISTINCT runs) = 1 AS comparable FROM r GROUP BY 1""",
}
