"""Text queries: cleaning, chunking, sentences, and comparing stated amounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.functions.identity import name_uuid
from corpusloom.operators import dedup, facets, quantities, retrieval, units
from corpusloom.sources.tables import table

SIZE, OVERLAP = 1000, 150


def processed(s: SparkSession, d: str) -> DataFrame:
    """Documents cleaned and without furniture: document id, hash, length, what was removed, or why nothing is left."""
    t = table(s, d, "documents").select("doc_id", "source", X.strip_furniture(X.clean("text")).alias("x"))
    t = t.select("doc_id", "source", F.col("x.text").alias("text"), F.size("x.removed").alias("removed"))
    hashed = F.sha2("text", 256)
    name = F.concat_ws(":", F.coalesce("source", F.lit("")), hashed)
    return t.select(
        "doc_id", name_uuid("6ba7b811-9dad-11d1-80b4-00c04fd430c8", name).alias("document_uuid"), hashed.alias("content_hash"), F.length("text").alias("characters"), "removed",
        F.when(F.col("text") == "", "empty_after_cleaning").alias("skipped"),
    )


def chunk_spans(s: SparkSession, d: str) -> DataFrame:
    """Chunks of cleaned documents: position and span, with the hash of the chunk's text."""
    t = table(s, d, "documents").select("doc_id", X.chunk(SIZE, OVERLAP)(X.clean("text")).alias("spans"))
    t = t.select("doc_id", F.posexplode("spans").alias("position", "span"))
    return t.select("doc_id", "position", F.col("span.start").alias("start_char"), F.col("span.end").alias("end_char"), F.col("span.hash").alias("chunk_hash"))


def simple_sentences(s: SparkSession, d: str) -> DataFrame:
    """English sentences of chunks by the conservative split: number and longest."""
    c = table(s, d, "pool_chunks").select("row_id", X.sentences_of(F.col("text")).alias("sentences"))
    return c.select("row_id", F.size("sentences").alias("sentences"), F.array_max(F.transform("sentences", F.length)).alias("longest"))


def number_masks(s: SparkSession, d: str) -> DataFrame:
    """Documents alike but for their numbers: masked text's hash, texts and ids."""
    t = table(s, d, "documents").filter("text is not null").select("doc_id", F.sha2(X.masked_numbers(X.topic_key(F.col("text"))), 256).alias("mask"))
    return t.groupBy("mask").agg(F.count("*").alias("documents"), F.min("doc_id").alias("least")).filter("documents > 1")


def amount_conflicts(s: SparkSession, d: str) -> DataFrame:
    """Per dimension, amounts of a chunk against the nearest one of the next chunk of its document: how many agree."""
    a = units.p1_found(table(s, d, "pool_chunks"), table(s, d, "unit_factors"))
    c = table(s, d, "pool_chunks").select("row_id", "document_id", "position", "text").filter("document_id is not null and position is not null")
    c = c.withColumn("f", facets.facets(F.col("text"))).drop("text")
    here = a.join(c.drop("f"), "row_id").select("document_id", "dimension", F.col("position").alias("place"), F.col("amount_milli").cast("double").alias("value"), F.col("row_id").alias("name"))
    there = here.withColumn("place", F.col("place") - 1)
    near = quantities.nearest(here, there, ["document_id", "dimension", "place"], "value", "name")
    near = near.join(c.select(F.col("row_id").alias("name"), F.col("f").alias("fa")), "name").join(c.select(F.col("row_id").alias("other_name"), F.col("f").alias("fb")), "other_name")
    side = lambda v, f: F.struct(F.col(v).alias("value"), F.col(v).alias("low"), F.col(v).alias("high"), F.lit(1.0).alias("step"), F.lit(False).alias("approximate"), F.col("dimension").alias("dimension"), F.lit(None).cast("string").alias("unit"), F.lit(None).cast("string").alias("stated"), *[F.col(f)[n].alias(n) for n in ("period", "per", "baseline", "method", "scope")])
    return near.withColumn("class", quantities.pair_class(side("value", "fa"), side("other_value", "fb"))).groupBy("dimension", "class").agg(F.count("*").alias("pairs"))


def kept_papers(s: SparkSession, d: str) -> DataFrame:
    """Papers of a venue and year in record order, dropped if their fingerprint or provider id was kept before."""
    p = table(s, d, "paper_records").select(F.concat_ws("|", "venue", F.col("year").cast("string")).alias("shelf"), "paper_key", "fingerprint", "paper_id")
    return dedup.kept_unless_seen(p, "shelf", ["paper_key"], ["fingerprint", "paper_id"]).groupBy("shelf").agg(F.count("*").alias("kept"))


def merged_sources(s: SparkSession, d: str) -> DataFrame:
    """Per question, chunk sources merged on any shared key (fingerprint, DOI, URL), in row order."""
    c = table(s, d, "pool_chunks").filter("question_id is not null")
    c = c.select("question_id", "row_id", F.array_compact(F.array("source_fingerprint", "source.doi", "source.canonical_url")).alias("keys"), F.length("text").alias("size"))
    m = dedup.merged_candidates(c, "question_id", ["row_id"], "row_id", "keys", "size")
    return m.groupBy("question_id").agg(F.count("*").alias("candidates"), F.countDistinct("owner").alias("merged"))


def mmr_selection(s: SparkSession, d: str) -> DataFrame:
    """For every embedding whose id is divisible by 100, five chosen for relevance and variety among its nearest."""
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    near = retrieval.top_k_similar(q, e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector")), 30)
    full = near.join(q.withColumnRenamed("vector", "query_vector"), "query_id").join(e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector")), "item_id")
    return retrieval.mmr_per_query(full.select("query_id", "item_id", "query_vector", "vector", "similarity"), 5)


def _shares(s: SparkSession, d: str) -> DataFrame:
    """The first percentage of each English-style chunk, its step, whether it is approximate, and the chunk's facets."""
    c = table(s, d, "pool_chunks").filter("document_id is not null and position is not null and text is not null").groupBy("document_id", "position").agg(F.min("text").alias("text"))
    stated = F.regexp_extract("text", r"(\d+(?:\.\d+)?)%", 1)
    near = F.regexp_like("text", F.lit(r"(?:about|around|roughly|nearly|approximately)\s\d+(?:\.\d+)?%"))
    rows = c.select("document_id", "position", F.nullif(stated, F.lit("")).alias("stated"), near.alias("approximate"), facets.facets(F.col("text")).alias("f")).filter("stated is not null")
    value = F.col("stated").cast("double")
    return rows.select("document_id", "position", F.struct(
        value.alias("value"), value.alias("low"), value.alias("high"), quantities.step_of(F.col("stated")).alias("step"), "approximate", F.lit("percent").alias("dimension"), F.lit("%").alias("unit"), "stated",
        *[F.col("f")[n].alias(n) for n in ("period", "per", "baseline", "method", "scope")],
    ).alias("m"))


def share_conflicts(s: SparkSession, d: str) -> DataFrame:
    """First percentages of neighbouring chunks of a document, by class of the pair."""
    m = _shares(s, d)
    j = m.select("document_id", "position", F.col("m").alias("a")).join(m.select("document_id", (F.col("position") - 1).alias("position"), F.col("m").alias("b")), ["document_id", "position"])
    return j.groupBy(quantities.pair_class(F.col("a"), F.col("b")).alias("class")).agg(F.count("*").alias("pairs"))


def chunk_contexts(s: SparkSession, d: str) -> DataFrame:
    """The contexts that chunks state, kind:value, and how many chunks state each."""
    t = table(s, d, "pool_chunks").filter("text is not null").select("row_id", F.explode(facets.context_tokens(facets.facets(F.col("text")))).alias("context"))
    return t.groupBy("context").agg(F.count("*").alias("chunks"))


def facet_owners(s: SparkSession, d: str) -> DataFrame:
    """Years in a chunk and the percentages that own them: all where the year leads, else the nearest, the one before on a tie."""
    t = table(s, d, "pool_chunks").filter("text is not null").select("row_id", facets.places(F.col("text"), facets.PERCENT).alias("m"), F.explode(facets.places(F.col("text"), facets.YEAR)).alias("y")).filter("size(m) > 0")
    return t.select("row_id", F.col("y.value").alias("facet"), F.col("y.start").alias("facet_start"), F.array_join(facets.owners(F.col("y"), F.col("m")), ",").alias("owners"))


QUERIES = {f.__name__: f for f in (facet_owners, share_conflicts, chunk_contexts, processed, chunk_spans, simple_sentences, number_masks, amount_conflicts, kept_papers, merged_sources, mmr_selection)}


def _found(pattern: str, text: str = "lower(text)") -> str:
    return f"regexp_extract_all({text}, '{pattern}', 1)"


_SPANLESS = f"regexp_replace(lower(text), '{facets.SPANS}', ' ', 'g')"
_PERIOD = f"""list_transform({_found(facets.SPANS)}, lambda x: 'y' || regexp_replace(x, '\\s?[-–]\\s?', '-')) || list_transform({_found(facets.YEARS, _SPANLESS)}, lambda x: 'y' || x)
    || list_transform({_found(facets.DURATIONS)}, lambda x: 'd' || regexp_replace(regexp_replace(x, '\\s', '', 'g'), 's$', ''))"""
_FACETS = {"period": _PERIOD, "per": _found(facets.PER), "baseline": _found(facets.BASELINE), "method": _found(facets.METHOD), "scope": _found(facets.SCOPE)}
_LISTS = ", ".join(f"list_sort(list_distinct({v})) AS {k}_" for k, v in _FACETS.items())
_NULLED = ", ".join(f"CASE WHEN len({k}_) > 0 THEN {k}_ END AS {k}" for k in _FACETS)
_ROOM = "(a.step + b.step) / 2 + CASE WHEN a.near THEN 0.1 * a.v ELSE 0 END + CASE WHEN b.near THEN 0.1 * b.v ELSE 0 END"

PERCENT, YEAR = facets.PERCENT, facets.YEAR

ORACLE: dict[str, str] = {
    "chunk_contexts": f"""WITH f AS (SELECT {_LISTS} FROM pool_chunks WHERE text IS NOT NULL), t AS ({" UNION ALL ".join(f"SELECT '{k}:' || unnest({k}_) AS context FROM f" for k in _FACETS)}) SELECT context, count(*) AS chunks FROM t GROUP BY 1""",
    "share_conflicts": f"""WITH c AS (SELECT document_id, position, min(text) AS text FROM pool_chunks WHERE document_id IS NOT NULL AND position IS NOT NULL AND text IS NOT NULL GROUP BY ALL),
      l AS (SELECT document_id, position, nullif(regexp_extract(text, '(\\d+(?:\\.\\d+)?)%', 1), '') AS stated, regexp_matches(text, '(?:about|around|roughly|nearly|approximately)\\s\\d+(?:\\.\\d+)?%') AS near, {_LISTS} FROM c),
      m AS (SELECT document_id, position, stated, near, CAST(stated AS DOUBLE) AS v, pow(10.0, -length(regexp_extract(stated, '[.,](\\d+)$', 1))) AS step, {_NULLED} FROM l WHERE stated IS NOT NULL),
      k AS (SELECT CASE WHEN CASE WHEN a.per IS NULL AND b.per IS NULL THEN false WHEN a.per IS NULL OR b.per IS NULL THEN true ELSE NOT list_has_any(a.per, b.per) END THEN 'different_measure'
          WHEN coalesce(a.period <> b.period AND list_has_any(list_transform(a.period, lambda x: x[1]), list_transform(b.period, lambda x: x[1])), false) OR coalesce(a.baseline <> b.baseline, false) THEN 'different_period'
          WHEN coalesce(a.method <> b.method, false) OR coalesce(a.scope <> b.scope, false) THEN 'different_scope'
          WHEN a.v - ({_ROOM}) <= b.v AND b.v - ({_ROOM}) <= a.v THEN 'agree'
          WHEN a.period = b.period AND a.scope IS NOT NULL AND b.scope IS NOT NULL AND (a.baseline IS NULL) = (b.baseline IS NULL) AND (a.method IS NULL) = (b.method IS NULL) THEN 'disagree' ELSE 'unresolved' END AS class
        FROM m a JOIN m b ON a.document_id = b.document_id AND b.position = a.position + 1) SELECT class, count(*) AS pairs FROM k GROUP BY 1""",
    "number_masks": """WITH t AS (SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(lower(text), '[\\s\\x{00a0}\\x{2000}-\\x{200a}\\x{202f}\\x{3000}\\x{0085}\\x{2028}\\x{2029}\\x{000b}]+', ' ', 'g'), '^ | $', '', 'g'), '\\d+(?:[.,]\\d+)*', '#', 'g')) AS mask FROM documents WHERE text IS NOT NULL)
      SELECT mask, count(*) AS documents, min(doc_id) AS least FROM t GROUP BY 1 HAVING count(*) > 1""",
    "kept_papers": """WITH RECURSIVE e AS (SELECT concat_ws('|', venue, CAST(year AS VARCHAR)) AS shelf, fingerprint AS f, paper_id AS i, row_number() OVER (PARTITION BY concat_ws('|', venue, CAST(year AS VARCHAR)) ORDER BY paper_key) AS n FROM paper_records),
      r AS (SELECT DISTINCT shelf, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS fs, CAST([] AS VARCHAR[]) AS ids, CAST(0 AS BIGINT) AS kept FROM e
        UNION ALL SELECT shelf, n, CASE WHEN fresh THEN list_append(fs, f) ELSE fs END, CASE WHEN fresh THEN list_append(ids, i) ELSE ids END, kept + CAST(fresh AS BIGINT)
        FROM (SELECT r.shelf, e.n, fs, ids, kept, f, i, NOT coalesce(list_contains(fs, f), false) AND NOT coalesce(list_contains(ids, i), false) AS fresh FROM r JOIN e ON e.shelf = r.shelf AND e.n = r.n + 1))
      SELECT shelf, max(kept) AS kept FROM r GROUP BY 1""",
    "merged_sources": """WITH RECURSIVE e AS (SELECT question_id, list_distinct(list_filter([source_fingerprint, source.doi, source.canonical_url], lambda x: x IS NOT NULL)) AS mine, row_number() OVER (PARTITION BY question_id ORDER BY row_id) AS n FROM pool_chunks WHERE question_id IS NOT NULL),
      r AS (SELECT DISTINCT question_id, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(k VARCHAR, o BIGINT)[]) AS own, CAST(0 AS BIGINT) AS groups FROM e
        UNION ALL SELECT question_id, n, list_concat(list_filter(own, lambda x: NOT list_contains(mine, x.k)), list_transform(mine, lambda m: {'k': m, 'o': coalesce(list_min(hits), groups)})), groups + CAST(len(hits) = 0 AS BIGINT)
        FROM (SELECT r.question_id, e.n, own, groups, mine, list_transform(list_filter(own, lambda x: list_contains(mine, x.k)), lambda x: x.o) AS hits FROM r JOIN e ON e.question_id = r.question_id AND e.n = r.n + 1))
      SELECT question_id, max(n) AS candidates, max(groups) AS merged FROM r GROUP BY 1""",
    "facet_owners": f"""WITH t AS (SELECT row_id, text, regexp_extract_all(text, '{PERCENT}') AS mv, string_split_regex(text, '{PERCENT}') AS mp, regexp_extract_all(text, '{YEAR}') AS yv, string_split_regex(text, '{YEAR}') AS yp FROM pool_chunks WHERE text IS NOT NULL),
      m AS (SELECT row_id, list_transform(range(1, len(mv) + 1), lambda i: {{'s': CAST(list_sum(list_transform(mp[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(mv[1:i - 1], lambda x: length(x))), 0) AS BIGINT), 'v': mv[i]}}) AS ms,
        list_transform(range(1, len(yv) + 1), lambda i: {{'s': CAST(list_sum(list_transform(yp[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(yv[1:i - 1], lambda x: length(x))), 0) AS BIGINT), 'v': yv[i]}}) AS ys FROM t WHERE len(mv) > 0 AND len(yv) > 0),
      y AS (SELECT row_id, ms, unnest(ys) AS y FROM m), o AS (SELECT row_id, y.v AS facet, y.s AS facet_start, y.s + length(y.v) <= ms[1].s AS is_lead,
        list_min(list_transform(ms, lambda m: {{'d': greatest(0, greatest(m.s - (y.s + length(y.v)), y.s - (m.s + length(m.v)))), 'f': CASE WHEN m.s + length(m.v) <= y.s THEN 0 ELSE 1 END, 's': -m.s, 'v': m.v}})).v AS nearest, array_to_string(list_transform(ms, lambda m: m.v), ',') AS every FROM y)
      SELECT row_id, facet, CAST(facet_start AS INTEGER) AS facet_start, CASE WHEN is_lead THEN every ELSE nearest END AS owners FROM o""",
}
