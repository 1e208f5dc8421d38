"""Identity queries over papers and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import identity as I
from corpusloom.functions import text as X
from corpusloom.sources.tables import table

_TRACK = ", ".join(f"'{t}'" for t in I.TRACKING)


def _duck_url(c: str) -> str:
    """DuckDB's form of `canonical_url`."""
    raw = f"trim(coalesce({c}, ''))"
    rx = r"'^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$'"
    part = lambda k: f"regexp_extract({raw}, {rx}, {k})"
    place = f"regexp_replace(lower(regexp_replace({part(2)}, '^.*@', '')), '^www\\.', '')"
    port = f"regexp_extract({place}, ':(\\d+)$', 1)"
    host = f"regexp_replace({place}, ':\\d*$', '')"
    net = f"CASE WHEN {port} = '' OR (lower({part(1)}) = 'http' AND {port} = '80') OR (lower({part(1)}) = 'https' AND {port} = '443') THEN {host} ELSE {host} || ':' || {port} END"
    path = f"CASE WHEN length({part(3)}) <= 1 THEN '/' ELSE regexp_replace({part(3)}, '/+$', '') END"
    dec = lambda x: f"url_decode(replace({x}, '+', ' '))"
    enc = lambda x: f"replace(url_encode({x}), '%20', '+')"
    pairs = f"list_transform(list_filter(string_split({part(4)}, '&'), lambda p: p <> ''), lambda p: {{'k': {dec("string_split(p, '=')[1]")}, 'v': {dec("regexp_replace(p, '^[^=]*=?', '')")}}})"
    query = f"array_to_string(list_transform(list_sort(list_filter({pairs}, lambda p: lower(p.k) NOT IN ({_TRACK}))), lambda p: {enc('p.k')} || '=' || {enc('p.v')}), '&')"
    return f"CASE WHEN {raw} = '' THEN '' WHEN {part(2)} <> '' THEN lower({part(1)}) || '://' || ({net}) || ({path}) || CASE WHEN {query} = '' THEN '' ELSE '?' || {query} END ELSE {raw} END"


def _duck_doi(c: str) -> str:
    raw = f"trim({c})"
    host = f"lower(regexp_extract({raw}, '(?i)^https?://([^/]+)/.+', 1))"
    path = f"CASE WHEN {host} IN ('doi.org', 'dx.doi.org', 'www.doi.org') THEN regexp_replace({raw}, '(?i)^https?://[^/]+/', '') ELSE {raw} END"
    return f"nullif(lower(regexp_replace(trim(regexp_replace({path}, '(?i)^doi:', '')), '^/+|/+$', '', 'g')), '')"


def url_canonical(s: SparkSession, d: str) -> DataFrame:
    """web_key, canonical URL, host and fingerprint of each page address."""
    w = table(s, d, "web_results").select("web_key", "rank", I.canonical_url(F.col("url")).alias("canonical"))
    return w.select("web_key", "rank", "canonical", I.host_of_canonical(F.col("canonical")).alias("host"), F.sha2(F.regexp_replace("canonical", r"^http://", "https://"), 256).alias("url_hash"))


def source_fingerprints(s: SparkSession, d: str) -> DataFrame:
    """The fingerprint of each source: a page's is that of its URL, a paper's of DOI, URL or id; and which rule gives the stored one.

    rule: 'url' or 'source' where that fingerprint is the stored one, null where
    neither is (papers whose DOI was lost after they were stored).
    """
    w = table(s, d, "web_results").select(F.lit("web").alias("kind"), F.col("web_key").alias("key"), "doi", "url", F.lit(None).cast("string").alias("external_id"), "fingerprint")
    p = table(s, d, "paper_records").select(F.lit("paper").alias("kind"), F.col("paper_key").alias("key"), "doi", "url", F.col("paper_id").alias("external_id"), "fingerprint")
    both = w.unionByName(p).select("kind", "key", "fingerprint", I.url_fingerprint(F.col("url")).alias("u"), I.source_fingerprint(F.col("doi"), F.col("url"), F.col("external_id")).alias("x"))
    rule = F.when(F.col("u") == F.col("fingerprint"), "url").when(F.col("x") == F.col("fingerprint"), "source")
    return both.select("kind", "key", F.when(F.col("kind") == "web", F.col("u")).otherwise(F.col("x")).alias("made"), rule.alias("rule"))


def doi_bare(s: SparkSession, d: str) -> DataFrame:
    """DOIs of both kinds in their bare form."""
    w = table(s, d, "web_results").select(F.col("web_key").alias("key"), "doi")
    p = table(s, d, "paper_records").select(F.col("paper_key").alias("key"), "doi")
    return w.unionByName(p).filter("doi is not null").select("key", I.normalised_doi(F.col("doi")).alias("bare"))


def paper_identity_keys(s: SparkSession, d: str) -> DataFrame:
    """paper_key and every key the paper may be known by, one row each."""
    p = table(s, d, "paper_records")
    keys = I.paper_keys(F.col("fingerprint"), F.col("doi"), F.col("external_ids"), F.col("url"))
    return p.select("paper_key", F.explode(keys).alias("identity_key")).distinct()


def host_diversity(s: SparkSession, d: str) -> DataFrame:
    """Per query: results, distinct hosts and distinct fingerprints."""
    w = table(s, d, "web_results")
    return w.groupBy("query").agg(F.count("*").alias("results"), F.countDistinct(I.host_of(F.col("url"))).alias("hosts"), F.countDistinct("fingerprint").alias("sources"))


def unified_sources(s: SparkSession, d: str) -> DataFrame:
    """Pages and papers as one source schema: kind, key, title, year, depth, length of text."""
    w = table(s, d, "web_results").select(
        F.lit("web").alias("kind"), F.col("web_key").alias("key"), I.collapsed(F.col("title")).alias("title"), I.publication_year(F.col("published_date")).alias("year"),
        F.coalesce(F.length("content"), F.lit(0)).alias("text_length"), F.lit("snippet").alias("depth"),
    )
    p = table(s, d, "paper_records").select(
        F.lit("paper").alias("kind"), F.col("paper_key").alias("key"), I.collapsed(F.col("title")).alias("title"), I.plausible_year(F.col("year")).alias("year"),
        F.coalesce(F.length("abstract"), F.lit(0)).alias("text_length"), F.when(F.col("abstract").isNotNull(), "abstract").otherwise("metadata").alias("depth"),
    )
    return w.unionByName(p)


def citation_hints(s: SparkSession, d: str) -> DataFrame:
    """paper_key and how a reader would name the paper."""
    p = table(s, d, "paper_records")
    return p.select("paper_key", I.citation_hint(I.authors_kept(F.col("authors")), F.col("year")).alias("hint")).distinct()


def paper_search(s: SparkSession, d: str) -> DataFrame:
    """Papers of 2010 to 2020 with at least 20 citations and an abstract, normalised."""
    p = table(s, d, "paper_records").filter(F.col("year").between(2010, 2020) & (F.col("citation_count") >= 20) & F.col("abstract").isNotNull())
    return p.select("paper_key", "year", I.plausible_count(F.col("citation_count")).alias("citations"), F.size(I.authors_kept(F.col("authors"))).alias("authors")).distinct()


def keyword_queries(s: SparkSession, d: str) -> DataFrame:
    """Questions as keyword queries."""
    return table(s, d, "question_items").select("question_id", X.keywords(F.col("question")).alias("keywords")).distinct()


def content_hashes(s: SparkSession, d: str) -> DataFrame:
    """Chunks whose stored hash is or is not that of their text, and those whose text is shared, per depth."""
    c = table(s, d, "pool_chunks").select("depth", F.sha2("text", 256).alias("made"), "content_hash")
    return c.groupBy("depth").agg(F.count("*").alias("chunks"), F.count_if(F.col("made") == F.col("content_hash")).alias("agree"), F.countDistinct("made").alias("texts"))


def derived_ids(s: SparkSession, d: str) -> DataFrame:
    """A version 5 UUID of each document, from its source and text hash."""
    c = table(s, d, "documents").filter("text is not null")
    name = F.concat_ws(":", F.coalesce("source", F.lit("")), F.sha2("text", 256))
    return c.select("doc_id", I.name_uuid("6ba7b811-9dad-11d1-80b4-00c04fd430c8", name).alias("document_uuid"))


QUERIES = {f.__name__: f for f in (url_canonical, source_fingerprints, doi_bare, paper_identity_keys, host_diversity, unified_sources, citation_hints, paper_search, keyword_queries, content_hashes, derived_ids)}

_YEAR = "try_cast(regexp_extract(trim(published_date), '^(\\d{4})', 1) AS INTEGER)"
_BASIS = "regexp_replace({}, '^http://', 'https://')"
_KIND = """CASE WHEN trim(doi) <> '' THEN 'doi:' || lower(trim(doi)) WHEN trim(url) <> '' THEN 'url:' || {} WHEN trim(external_id) <> '' THEN 'ext:' || trim(external_id) END"""
_DROPPED = ", ".join(f"'{w}'" for w in X.DROPPED)
_LEADS = ", ".join(f"'{w}'" for w in X.LEADS)

ORACLE = {
    "url_canonical": f"SELECT web_key, rank, canonical, regexp_extract(canonical, '^[^:]+://([^/:?]+)', 1) AS host, sha256({_BASIS.format('canonical')}) AS url_hash FROM (SELECT web_key, rank, {_duck_url('url')} AS canonical FROM web_results)",
    "source_fingerprints": f"""SELECT kind, key, CASE WHEN kind = 'web' THEN u ELSE x END AS made, CASE WHEN u = fingerprint THEN 'url' WHEN x = fingerprint THEN 'source' END AS rule FROM (
        SELECT kind, key, fingerprint, sha256({_BASIS.format(_duck_url('url'))}) AS u, sha256({_KIND.format(_BASIS.format(_duck_url('url')))}) AS x FROM (
        SELECT 'web' AS kind, web_key AS key, doi, url, CAST(NULL AS VARCHAR) AS external_id, fingerprint FROM web_results
        UNION ALL SELECT 'paper', paper_key, doi, url, paper_id, fingerprint FROM paper_records))""",
    "doi_bare": f"SELECT key, {_duck_doi('doi')} AS bare FROM (SELECT web_key AS key, doi FROM web_results UNION ALL SELECT paper_key, doi FROM paper_records) WHERE doi IS NOT NULL",
    "paper_identity_keys": f"""SELECT DISTINCT paper_key, identity_key FROM (
        SELECT paper_key, fingerprint AS identity_key FROM paper_records WHERE fingerprint IS NOT NULL
        UNION ALL SELECT paper_key, 'doi:' || {_duck_doi('doi')} FROM paper_records WHERE {_duck_doi('doi')} IS NOT NULL
        UNION ALL SELECT paper_key, lower(e.key) || ':' || lower(e.value) FROM (SELECT paper_key, unnest(map_entries(external_ids)) AS e FROM paper_records))""",
    "host_diversity": f"SELECT query, count(*) AS results, count(DISTINCT regexp_extract({_duck_url('url')}, '^[^:]+://([^/:?]+)', 1)) AS hosts, count(DISTINCT fingerprint) AS sources FROM web_results GROUP BY query",
    "unified_sources": f"""SELECT 'web' AS kind, web_key AS key, nullif(trim(regexp_replace(title, '[\\s\\x{{00a0}}\\x{{202f}}\\x{{2009}}\\x{{3000}}]+', ' ', 'g')), '') AS title,
          CASE WHEN {_YEAR} > 1400 AND {_YEAR} < 2200 THEN {_YEAR} END AS year, CAST(coalesce(length(content), 0) AS INTEGER) AS text_length, 'snippet' AS depth FROM web_results
        UNION ALL SELECT 'paper', paper_key, nullif(trim(regexp_replace(title, '[\\s\\x{{00a0}}\\x{{202f}}\\x{{2009}}\\x{{3000}}]+', ' ', 'g')), ''), CASE WHEN year BETWEEN 1400 AND 2200 THEN year END, CAST(coalesce(length(abstract), 0) AS INTEGER), CASE WHEN abstract IS NOT NULL THEN 'abstract' ELSE 'metadata' END FROM paper_records""",
    "citation_hints": """SELECT DISTINCT paper_key, CASE WHEN coalesce(len(a), 0) < 1 THEN 'Unknown' WHEN len(a) = 1 THEN string_split_regex(a[1], '\\s+')[-1] ELSE string_split_regex(a[1], '\\s+')[-1] || ' et al.' END || coalesce(' (' || CAST(year AS VARCHAR) || ')', '') AS hint
        FROM (SELECT paper_key, year, list_filter(list_transform(authors, lambda x: trim(x)), lambda x: x <> '') AS a FROM paper_records)""",
    "paper_search": """SELECT DISTINCT paper_key, year, citation_count AS citations, CAST(len(list_filter(authors, lambda x: trim(x) <> '')) AS INTEGER) AS authors
        FROM paper_records WHERE year BETWEEN 2010 AND 2020 AND citation_count >= 20 AND abstract IS NOT NULL""",
    "keyword_queries": f"""SELECT DISTINCT question_id, CASE WHEN suffix(t, '?') OR lower(regexp_extract(t, '^(\\S+)', 1)) IN ({_LEADS})
          THEN coalesce(nullif(array_to_string(list_filter(regexp_extract_all(t, '[A-Za-z0-9][A-Za-z0-9.\\-]*'), lambda w: lower(w) NOT IN ({_DROPPED})), ' '), ''), t) ELSE t END AS keywords
        FROM (SELECT question_id, regexp_replace(question, '^[\\s\\x{{00a0}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{3000}}]+|[\\s\\x{{00a0}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{3000}}]+$', '', 'g') AS t FROM question_items)""",
    "content_hashes": "SELECT depth, count(*) AS chunks, count(*) FILTER (WHERE sha256(text) = content_hash) AS agree, count(DISTINCT sha256(text)) AS texts FROM pool_chunks GROUP BY depth",
    "derived_ids": """WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(coalesce(source, '') || ':' || sha256(text))) AS x FROM documents WHERE text IS NOT NULL)
      SELECT doc_id, x[1:8] || '-' || x[9:12] || '-5' || x[14:16] || '-' || ['8', '9', 'a', 'b'][(strpos('0123456789abcdef', x[17]) - 1) % 4 + 1] || x[18:20] || '-' || x[21:32] AS document_uuid FROM h""",
}
