"""Queries of the core operators over the test tables, and the SQL to hold them against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dispatchlake.functions import facts, ids, moments, numbers, text, vec
from dispatchlake.functions.tables import table
from dispatchlake.operators import archive, quality, relational, selection, similarity, stories, timestamps
from dispatchlake.plans import ranking
from dispatchlake.streaming import front

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {"p1_found": timestamps.found}
_SQL: dict[str, str] = {}

#: The present of the test tables.
NOW = "2026-03-10T00:00:00Z"
_SPACE = r"[\s\x0b\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return put


def _now(at: str = NOW) -> Column:
    return F.lit(at).cast("timestamp")


def _us(c: str | Column) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp") if isinstance(c, str) else c)


# Documents and identities


@query(rf"""
WITH f AS (SELECT doc_id, source, sha256(lower(trim(regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g')))) AS fp FROM documents),
c AS (SELECT fp, min(doc_id) AS first_doc, max(doc_id) AS last_doc, count(*) AS n_docs, count(DISTINCT source) AS source_count FROM f GROUP BY fp)
SELECT 'clt_' || substr(fp, 1, 16) AS cluster_id, first_doc, last_doc, n_docs, source_count FROM c
""")
def fingerprint_clusters(s: SparkSession, d: str) -> DataFrame:
    """Clusters of documents with one fingerprint."""
    docs = table(s, d, "documents").select("doc_id", "source", F.sha2(F.lower(text.folded(F.coalesce("text", F.lit("")))), 256).alias("fp"))
    each = docs.groupBy("fp").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count("*").alias("n_docs"), F.countDistinct("source").alias("source_count"))
    return each.select(ids.cluster_id(F.col("fp")).alias("cluster_id"), "first_doc", "last_doc", "n_docs", "source_count").orderBy(F.desc("source_count"), "cluster_id")


@query(r"""
WITH u AS (SELECT raw_id, regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?', ['s', 'h', 'p', 'q']) AS m FROM (SELECT DISTINCT raw_id, url FROM raw_items)),
v AS (SELECT raw_id, lower(m.s) AS s, lower(regexp_replace(m.h, '^.*@', '')) AS h, CASE WHEN length(m.p) > 1 THEN regexp_replace(m.p, '/+$', '') ELSE m.p END AS p,
  array_to_string(list_transform(list_sort(list_transform(list_filter(string_split(m.q, '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_|pk_|mtm_)|^(fbclid|gclid|gbraid|wbraid|dclid|msclkid|ref|ref_src|ref_url|source|spm|scm|mc_cid|mc_eid|igshid|yclid|_hsenc|_hsmi)(=|$)')),
    lambda x: replace(CASE WHEN contains(x, '=') THEN x ELSE x || '=' END, '=', chr(1)))), lambda x: replace(x, chr(1), '=')), '&') AS q FROM u)
SELECT raw_id, s || '://' || CASE WHEN s = 'http' THEN regexp_replace(h, ':80$', '') WHEN s = 'https' THEN regexp_replace(h, ':443$', '') ELSE h END || p || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS normalized_url FROM v
""")
def normalize_url(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "raw_items").select("raw_id", "url").distinct().select("raw_id", ids.normalized_url(F.col("url")).alias("normalized_url"))


@query("SELECT item_seq, item_id, 'clt_' || substr(item_id, 1, 16) AS cluster_id, item_id || ':hn:points' AS source_id FROM news_items")
def item_ids(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "news_items").withColumn("made", ids.item_id(F.col("url"), F.col("title"), F.col("content")))
    return n.select("item_seq", F.col("made").alias("item_id"), ids.cluster_id(F.col("made")).alias("cluster_id"), ids.source_id(F.col("made"), F.lit("hn"), F.lit("points")).alias("source_id"))


@query("""
SELECT id, 'int_' || substr(sha256(lower(trim(board_domain)) || '|' || coalesce(array_to_string(list_sort(list_transform(enrich, lambda x: lower(x))), ','), '')), 1, 12) AS interest_key FROM sources
""")
def interest_keys(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "sources").select("id", ids.interest_key(F.col("board_domain"), F.col("enrich")).alias("interest_key"))


# Scans and filters


@query("SELECT item_seq, rank() OVER (ORDER BY published_at DESC NULLS LAST, item_id) AS place FROM news_items WHERE fetched_at >= TIMESTAMPTZ '2026-03-01 00:00:00+00'")
def items_recent_nulls_last(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "news_items").where(F.col("fetched_at") >= F.lit("2026-03-01T00:00:00Z").cast("timestamp"))
    return n.select("item_seq", F.rank().over(Window.orderBy(F.desc_nulls_last("published_at"), "item_id")).cast("long").alias("place"))


@query("SELECT item_seq, item_id, lang FROM news_items WHERE cluster_id IS NULL")
def unclustered_items(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "news_items").where("cluster_id is null").select("item_seq", "item_id", "lang").orderBy("item_seq")


@query("""
SELECT n.item_seq, coalesce(length(n.content), 0) AS n_chars FROM news_items n JOIN sources s ON n.source = s.id
WHERE list_contains(s.enrich, 'fulltext') AND n.fetched_at >= TIMESTAMPTZ '2026-02-15 00:00:00+00' AND coalesce(length(n.content), 0) < 400
  AND (n.facts IS NULL OR json_extract(n.facts, '$.fulltext') IS NULL)
""")
def fulltext_candidates(s: SparkSession, d: str) -> DataFrame:
    src = table(s, d, "sources").where(F.array_contains("enrich", "fulltext")).select(F.col("id").alias("source"))
    n = table(s, d, "news_items").where((F.col("fetched_at") >= F.lit("2026-02-15T00:00:00Z").cast("timestamp")) & (F.coalesce(F.length("content"), F.lit(0)) < 400))
    lacks = F.col("facts").isNull() | F.get_json_object("facts", "$.fulltext").isNull()
    return n.where(lacks).join(src, "source", "left_semi").select("item_seq", F.coalesce(F.length("content"), F.lit(0)).cast("long").alias("n_chars"))


@query("""
SELECT n.item_seq, n.published_at IS NULL AS undated FROM news_items n
WHERE n.source IN (SELECT id FROM sources WHERE enabled AND NOT board_only) AND (n.published_at >= TIMESTAMPTZ '2026-03-01 00:00:00+00' OR n.published_at IS NULL)
""")
def recent_or_undated_of_sources(s: SparkSession, d: str) -> DataFrame:
    src = table(s, d, "sources").where("enabled and not board_only").select(F.col("id").alias("source"))
    n = table(s, d, "news_items").where(F.col("published_at").isNull() | (F.col("published_at") >= F.lit("2026-03-01T00:00:00Z").cast("timestamp")))
    return n.join(src, "source", "left_semi").select("item_seq", F.col("published_at").isNull().alias("undated"))


@query("""
SELECT raw_id, source FROM (SELECT r.raw_id, r.source, row_number() OVER (PARTITION BY r.source ORDER BY r.raw_id) AS rn, coalesce(s.max_items, 50) AS cap
  FROM (SELECT DISTINCT raw_id, source, url, title FROM raw_items) r LEFT JOIN sources s ON r.source = s.id
  WHERE NOT regexp_matches(coalesce(r.title, ''), '^(404|Error)') AND NOT regexp_matches(coalesce(r.url, ''), '/(video|podcast)s?/')) WHERE rn <= cap
""")
def exclude_then_head_per_source(s: SparkSession, d: str) -> DataFrame:
    """Exclusion patterns first, then each source's cap."""
    r = table(s, d, "raw_items").select("raw_id", "source", "url", "title").distinct()
    bad = text.matches_any(F.col("title"), F.array(F.lit("^(404|Error)"))) | text.matches_any(F.col("url"), F.array(F.lit("/(video|podcast)s?/")))
    cap = table(s, d, "sources").select(F.col("id").alias("source"), "max_items")
    rows = r.where(~bad).join(cap, "source", "left")
    return relational.head_per_group(rows, ["source"], [F.col("raw_id")], F.coalesce("max_items", F.lit(50))).select("raw_id", "source")


@query("""
SELECT n.item_seq, s.board_domain FROM news_items n JOIN sources s ON n.source = s.id WHERE s.board_domain = 'bio'
""")
def items_of_domain(s: SparkSession, d: str) -> DataFrame:
    src = table(s, d, "sources").where("board_domain = 'bio'").select(F.col("id").alias("source"), "board_domain")
    return table(s, d, "news_items").join(src, "source").select("item_seq", "board_domain")


@query("SELECT id FROM summaries WHERE contains(lower(headline || ' ' || coalesce(tldr_rendered, '')), 'solar kiln') AND pruned_at IS NULL")
def literal_search(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "summaries").where(F.col("pruned_at").isNull() & F.contains(F.lower(F.concat("headline", F.lit(" "), F.coalesce("tldr_rendered", F.lit("")))), F.lit("solar kiln"))).select("id")


@query("""
SELECT n.item_seq, n.published_at IS NULL OR (epoch_us(TIMESTAMPTZ '2026-03-10 00:00:00+00') - epoch_us(n.published_at)) / 3.6e9 <= coalesce(s.freshness_hours, 24) AS passes_undated,
  coalesce((epoch_us(TIMESTAMPTZ '2026-03-10 00:00:00+00') - epoch_us(n.published_at)) / 3.6e9 <= coalesce(s.freshness_hours, 24), false) AS passes_dated
FROM news_items n LEFT JOIN sources s ON n.source = s.id
""")
def freshness(s: SparkSession, d: str) -> DataFrame:
    """Both rules: undated items pass one and fail the other."""
    src = table(s, d, "sources").select(F.col("id").alias("source"), "freshness_hours")
    n, hours, at = table(s, d, "news_items").join(src, "source", "left"), F.coalesce("freshness_hours", F.lit(24)), F.col("published_at")
    return n.select("item_seq", moments.fresh_or_undated(at, _now(), hours).alias("passes_undated"), moments.fresh_and_dated(at, _now(), hours).alias("passes_dated"))


@query("""
SELECT cluster_id, count(*) AS n_items FROM news_items n LEFT JOIN sources s ON n.source = s.id WHERE cluster_id IS NOT NULL
GROUP BY cluster_id HAVING bool_or(coalesce(s.mixed, false)) AND sum(CASE WHEN NOT coalesce(s.mixed, false) THEN 1 ELSE 0 END) = 0
""")
def mixed_only_clusters(s: SparkSession, d: str) -> DataFrame:
    """Clusters with a member of a mixed source and none of another."""
    n = table(s, d, "news_items").where("cluster_id is not null").join(table(s, d, "sources").select(F.col("id").alias("source"), "mixed"), "source", "left").withColumn("mixed", F.coalesce("mixed", F.lit(False)))
    return n.groupBy("cluster_id").agg(F.count("*").alias("n_items"), F.bool_or("mixed").alias("m"), F.sum((~F.col("mixed")).cast("int")).alias("p")).where("m and p = 0").select("cluster_id", "n_items")


# Joins and sets


@query("""
SELECT n.item_seq, v.vec_id, coalesce(s.weight, 0.5) AS weight, coalesce(s.freshness_hours, 24) AS freshness_hours, greatest(coalesce(c.source_count, 1), 1) AS source_count
FROM news_items n JOIN item_vectors v USING (item_id) LEFT JOIN sources s ON n.source = s.id LEFT JOIN clusters c ON n.cluster_id = c.cluster_id WHERE v.embedding IS NOT NULL
""")
def candidates_enriched(s: SparkSession, d: str) -> DataFrame:
    """Items with a vector, with registry and cluster values or their defaults."""
    v = table(s, d, "item_vectors").where("embedding is not null").select("item_id", "vec_id")
    n = table(s, d, "news_items").select("item_seq", "item_id", "source", "cluster_id").join(v, "item_id")
    n = n.join(table(s, d, "sources").select(F.col("id").alias("source"), "weight", "freshness_hours"), "source", "left").join(table(s, d, "clusters").select("cluster_id", "source_count"), "cluster_id", "left")
    return n.select("item_seq", "vec_id", F.coalesce("weight", F.lit(0.5)).alias("weight"), F.coalesce("freshness_hours", F.lit(24)).alias("freshness_hours"), F.greatest(F.coalesce("source_count", F.lit(1)), F.lit(1)).alias("source_count"))


@query("SELECT s.id, coalesce(s.headline, c.title) AS title FROM summaries s LEFT JOIN clusters c ON s.cluster_id = c.cluster_id JOIN news_items n ON n.item_id = s.item_id WHERE s.pruned_at IS NULL")
def cards_with_items(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "clusters").select("cluster_id", "title")
    live = table(s, d, "summaries").where("pruned_at is null").select("id", "item_id", "cluster_id", "headline")
    return live.join(table(s, d, "news_items").select("item_id"), "item_id").join(c, "cluster_id", "left").select("id", F.coalesce("headline", "title").alias("title"))


@query("SELECT DISTINCT n.source FROM raw_items n WHERE n.source NOT IN (SELECT id FROM sources WHERE enabled)")
def sources_without_registry(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "raw_items").select("source").where("source is not null").distinct().join(table(s, d, "sources").where("enabled").select(F.col("id").alias("source")), "source", "left_anti")


@query("""
SELECT item_id, min(part) AS part FROM (SELECT item_id, 0 AS part FROM summaries WHERE review_state = 'ok' UNION ALL SELECT first_item_id, 1 FROM clusters WHERE source_count >= 3
  UNION ALL SELECT item_id, 2 FROM news_items WHERE category = 'official') WHERE item_id IS NOT NULL GROUP BY item_id
""")
def candidate_pool(s: SparkSession, d: str) -> DataFrame:
    """Union of pools; the first pool that has an item names it."""
    a = table(s, d, "summaries").where("review_state = 'ok'").select("item_id")
    b = table(s, d, "clusters").where("source_count >= 3").select(F.col("first_item_id").alias("item_id"))
    c = table(s, d, "news_items").where("category = 'official'").select("item_id")
    return relational.first_of_union([x.where("item_id is not null") for x in (a, b, c)], "item_id").select("item_id", F.col("part").cast("int").alias("part"))


# Aggregations


@query("SELECT source, count(*) AS n_items, max(epoch_us(published_at)) AS newest_us, count(published_at) AS n_dated FROM news_items GROUP BY source")
def source_stats(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "news_items").groupBy("source").agg(F.count("*").alias("n_items"), F.max(_us("published_at")).alias("newest_us"), F.count("published_at").alias("n_dated")).orderBy(F.desc("n_items"), "source")


@query("SELECT cluster_id, count(DISTINCT source) AS source_count, min(epoch_us(published_at)) AS first_us, max(epoch_us(published_at)) AS last_us FROM news_items WHERE cluster_id IS NOT NULL GROUP BY cluster_id")
def cluster_refresh(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "news_items").where("cluster_id is not null")
    return n.groupBy("cluster_id").agg(F.countDistinct("source").alias("source_count"), F.min(_us("published_at")).alias("first_us"), F.max(_us("published_at")).alias("last_us"))


@query("""
SELECT board_domain, cluster_id, rn AS place FROM (SELECT board_domain, cluster_id, row_number() OVER (PARTITION BY board_domain ORDER BY n DESC, newest DESC, cluster_id) AS rn
  FROM (SELECT s.board_domain, n.cluster_id, count(DISTINCT n.source) AS n, max(n.fetched_at) AS newest FROM news_items n JOIN sources s ON n.source = s.id WHERE n.cluster_id IS NOT NULL GROUP BY ALL)) WHERE rn <= 50
""")
def cluster_candidates(s: SparkSession, d: str) -> DataFrame:
    """The widest-reported, then newest fifty clusters of each board."""
    src = table(s, d, "sources").select(F.col("id").alias("source"), "board_domain")
    n = table(s, d, "news_items").where("cluster_id is not null").select("source", "cluster_id", "fetched_at").join(src, "source")
    each = n.groupBy("board_domain", "cluster_id").agg(F.countDistinct("source").alias("n"), F.max("fetched_at").alias("newest"))
    w = Window.partitionBy("board_domain").orderBy(F.desc("n"), F.desc("newest"), "cluster_id")
    return each.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 50").select("board_domain", "cluster_id", "place")


_HEAT = """
WITH m AS (SELECT n.cluster_id, lower(trim(n.source)) AS family, coalesce(s.weight, 0.5) AS w, n.published_at FROM news_items n LEFT JOIN sources s ON n.source = s.id WHERE n.cluster_id IS NOT NULL AND trim(coalesce(n.source, '')) <> ''),
f AS (SELECT cluster_id, family, max(w) AS w FROM m GROUP BY ALL), t AS (SELECT cluster_id, max(published_at) AS peak FROM m GROUP BY ALL),
v AS (SELECT m.cluster_id, count(DISTINCT CASE WHEN published_at >= peak - INTERVAL 6 HOUR THEN family END) AS r, count(DISTINCT CASE WHEN published_at >= peak - INTERVAL 24 HOUR THEN family END) AS b FROM m JOIN t USING (cluster_id) GROUP BY ALL),
a AS (SELECT cluster_id, sum(w) AS weighted FROM f GROUP BY ALL)
"""


@query(_HEAT + "SELECT cluster_id, round(weighted, 6) AS weighted, round(CASE WHEN b > 0 THEN least(r / b, 2.0) ELSE 0 END, 6) AS velocity, round(ln(1 + weighted) * (1 + CASE WHEN b > 0 THEN least(r / b, 2.0) ELSE 0 END), 6) AS heat FROM a JOIN v USING (cluster_id)")
def cluster_heat(s: SparkSession, d: str) -> DataFrame:
    """Weight of different source families, their speed in the last hours before the peak, and both as heat."""
    src = table(s, d, "sources").select(F.col("id").alias("source"), "weight")
    m = table(s, d, "news_items").where("cluster_id is not null").select("cluster_id", "source", "published_at").join(src, "source", "left")
    m = m.select("cluster_id", text.source_family(F.col("source")).alias("family"), F.coalesce("weight", F.lit(0.5)).alias("w"), "published_at").where("family <> ''")
    each = m.groupBy("cluster_id", "family").agg(F.max("w").alias("w"), F.max("published_at").alias("newest"))
    peak = Window.partitionBy("cluster_id")
    late = lambda h: F.count_if(F.unix_micros("newest") >= F.unix_micros("peak") - h * 3_600_000_000)
    a = each.withColumn("peak", F.max("newest").over(peak)).groupBy("cluster_id").agg(F.sum("w").alias("weighted"), late(6).alias("r"), late(24).alias("b"))
    v = F.when(F.col("b") > 0, F.least(F.col("r") / F.col("b"), F.lit(2.0))).otherwise(0.0)
    return a.select("cluster_id", F.round("weighted", 6).alias("weighted"), F.round(v, 6).alias("velocity"), F.round(F.log1p("weighted") * (1 + v), 6).alias("heat"))


@query("""
SELECT cluster_id, board_domain FROM (SELECT cluster_id, board_domain, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, board_domain) AS rn FROM (SELECT n.cluster_id, s.board_domain, count(*) AS n FROM news_items n JOIN sources s ON n.source = s.id
 WHERE n.cluster_id IS NOT NULL AND s.board_domain IS NOT NULL GROUP BY ALL)) WHERE rn = 1
""")
def domain_majority(s: SparkSession, d: str) -> DataFrame:
    """The commonest domain among a cluster's members, ties to the first by name."""
    src = table(s, d, "sources").where("board_domain is not null").select(F.col("id").alias("source"), "board_domain")
    n = table(s, d, "news_items").where("cluster_id is not null").join(src, "source").groupBy("cluster_id", "board_domain").count()
    return n.groupBy("cluster_id").agg(F.min_by("board_domain", F.struct(-F.col("count"), "board_domain")).alias("board_domain"))


@query("""
SELECT cluster_id, item_seq AS representative FROM (SELECT cluster_id, item_seq, row_number() OVER (PARTITION BY cluster_id ORDER BY coalesce(length(content), 0) >= 80 DESC, published_at DESC NULLS LAST, item_seq) AS rn FROM news_items WHERE cluster_id IS NOT NULL) WHERE rn = 1
""")
def cluster_representative(s: SparkSession, d: str) -> DataFrame:
    """The latest member with a body, else the latest; undated counts as oldest."""
    n = table(s, d, "news_items").where("cluster_id is not null")
    best = F.struct((F.coalesce(F.length("content"), F.lit(0)) >= 80).alias("b"), F.coalesce(_us("published_at"), F.lit(-(2**62))).alias("t"), (-F.col("item_seq")).alias("i"))
    return n.groupBy("cluster_id").agg(F.max_by("item_seq", best).alias("representative"))


@query("""
SELECT coalesce(board_domain, '*') AS board_domain, coalesce(lang, '*') AS lang, count(*) AS n, round(avg(weight), 6) AS mean_weight FROM sources GROUP BY GROUPING SETS ((board_domain, lang), (board_domain), ())
""")
def registry_profile(s: SparkSession, d: str) -> DataFrame:
    src = table(s, d, "sources")
    return src.groupingSets([[F.col("board_domain"), F.col("lang")], [F.col("board_domain")], []], F.col("board_domain"), F.col("lang")).agg(F.count("*").alias("n"), F.round(F.avg("weight"), 6).alias("mean_weight")).select(F.coalesce("board_domain", F.lit("*")).alias("board_domain"), F.coalesce("lang", F.lit("*")).alias("lang"), "n", "mean_weight")


@query("SELECT coalesce(event_type, 'total') AS event_type, count(*) AS calls, round(sum(value), 2) AS total, count(DISTINCT user_id) AS users FROM events GROUP BY ROLLUP (event_type)")
def usage_rollup(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").rollup("event_type").agg(F.count("*").alias("calls"), F.round(F.sum(F.col("value").cast("decimal(18,4)")), 2).cast("double").alias("total"), F.countDistinct("user_id").alias("users"))
    return e.select(F.coalesce("event_type", F.lit("total")).alias("event_type"), "calls", "total", "users")


@query("""
SELECT source, count(*) AS n, max(len) AS longest, list_extract(list_reverse_sort(list(len)), count(*) // 10 + 1) AS p10, list_extract(list_reverse_sort(list(len)), count(*) // 4 + 1) AS p25, list_extract(list_reverse_sort(list(len)), count(*) // 2 + 1) AS median
FROM (SELECT source, n_chars AS len FROM documents WHERE n_chars IS NOT NULL) GROUP BY source
""")
def quantiles_by_index(s: SparkSession, d: str) -> DataFrame:
    """Entries of the descending order at a tenth, a quarter and the half: ranks, so no group is gathered."""
    docs = table(s, d, "documents").where("n_chars is not null").select("source", "n_chars")
    w = Window.partitionBy("source")
    ranked = docs.withColumn("rn", F.row_number().over(w.orderBy(F.desc("n_chars")))).withColumn("n", F.count("*").over(w))
    at = lambda k: F.max(F.when(F.col("rn") == F.floor(F.col("n") / k) + 1, F.col("n_chars")))
    return ranked.groupBy("source").agg(F.count("*").alias("n"), F.max("n_chars").alias("longest"), at(10).alias("p10"), at(4).alias("p25"), at(2).alias("median"))


@query("""
SELECT source, category, n, round(n / sum(n) OVER (PARTITION BY source), 6) AS share, n / sum(n) OVER (PARTITION BY source) > 0.5 AS over FROM (SELECT source, coalesce(category, '') AS category, count(*) AS n FROM news_items GROUP BY ALL)
""")
def drop_ratio_guard(s: SparkSession, d: str) -> DataFrame:
    """Shares of a group, and which are so large that dropping them is refused."""
    n = table(s, d, "news_items").groupBy("source", F.coalesce("category", F.lit("")).alias("category")).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("source"))
    return n.select("source", "category", "n", F.round(share, 6).alias("share"), (share > 0.5).alias("over"))


# Writes


@query("""
WITH o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY interest_key, item_id ORDER BY run_id DESC, id DESC) AS rn FROM summaries WHERE run_id < 'daily_20260225') WHERE rn = 1),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY interest_key, item_id ORDER BY run_id DESC, id DESC) AS rn FROM summaries WHERE run_id >= 'daily_20260225') WHERE rn = 1)
SELECT interest_key, item_id, CASE WHEN n.id IS NULL THEN o.id ELSE coalesce(o.id, n.id) END AS id, CASE WHEN n.id IS NULL THEN o.headline ELSE n.headline END AS headline, coalesce(n.produced_by, o.produced_by) AS produced_by, CASE WHEN n.id IS NULL THEN epoch_us(o.pruned_at) END AS pruned_us
FROM o FULL JOIN n USING (interest_key, item_id)
""")
def upsert_summaries(s: SparkSession, d: str) -> DataFrame:
    """Later runs put over earlier ones: the id stays, the headline is replaced, produced_by only if given, pruning is undone."""
    one = lambda c: relational.latest(table(s, d, "summaries").where(c).select("interest_key", "item_id", "id", "headline", "produced_by", _us("pruned_at").alias("pruned_us"), "run_id"), ["interest_key", "item_id"], [F.col("run_id"), F.col("id")]).drop("run_id")
    return relational.upsert(one("run_id < 'daily_20260225'"), one("run_id >= 'daily_20260225'").withColumn("pruned_us", F.lit(None).cast("long")), ["interest_key", "item_id"], replace=["headline", "pruned_us"], if_given=["produced_by"])


@query("""
SELECT item_id, min(model) AS model, count(*) AS n FROM (SELECT DISTINCT item_id, model FROM item_vectors WHERE item_id IS NOT NULL) GROUP BY item_id
""")
def insert_absent_models(s: SparkSession, d: str) -> DataFrame:
    """(item, model) pairs recorded once each however often they come, then counted."""
    v = table(s, d, "item_vectors").where("item_id is not null").select("item_id", "model")
    both = relational.insert_absent(v.where("model is not null").distinct(), v, ["item_id", "model"])
    return both.groupBy("item_id").agg(F.min("model").alias("model"), F.count("*").alias("n"))


@query("SELECT id, CASE WHEN pruned_at IS NULL AND interest_key = 'int_3fa1c09be772' AND NOT exists (SELECT 1 FROM clusters c WHERE c.first_item_id = s.item_id) THEN 1773100800000000 ELSE epoch_us(pruned_at) END AS pruned_us FROM summaries s")
def soft_prune_summaries(s: SparkSession, d: str) -> DataFrame:
    keep = table(s, d, "clusters").where("first_item_id is not null").select(F.col("first_item_id").alias("item_id"))
    old = table(s, d, "summaries").select("id", "item_id", "interest_key", "pruned_at")
    return relational.soft_prune(old, keep, F.col("interest_key") == "int_3fa1c09be772", ["item_id"], _now()).select("id", _us("pruned_at").alias("pruned_us"))


@query("SELECT id FROM summaries s WHERE interest_key <> 'int_3fa1c09be772' OR interest_key IS NULL OR exists (SELECT 1 FROM clusters c WHERE c.first_item_id = s.item_id)")
def prune_rows(s: SparkSession, d: str) -> DataFrame:
    keep = table(s, d, "clusters").where("first_item_id is not null").select(F.col("first_item_id").alias("item_id"))
    return relational.prune(table(s, d, "summaries").select("id", "item_id", "interest_key"), keep, F.col("interest_key") == "int_3fa1c09be772", ["item_id"]).select("id")


@query("SELECT vec_id FROM item_vectors v WHERE NOT exists (SELECT 1 FROM news_items n WHERE n.item_id = v.item_id)")
def orphan_vectors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "item_vectors").select("vec_id", "item_id").join(table(s, d, "news_items").select("item_id"), "item_id", "left_anti").select("vec_id")


@query("SELECT interest_key, item_id, id, run_id FROM (SELECT *, row_number() OVER (PARTITION BY interest_key, item_id ORDER BY created_at DESC, id DESC) AS rn FROM summaries) WHERE rn = 1")
def latest_per_key(s: SparkSession, d: str) -> DataFrame:
    return relational.latest(table(s, d, "summaries").select("interest_key", "item_id", "id", "run_id", "created_at"), ["interest_key", "item_id"], [F.col("created_at"), F.col("id")]).select("interest_key", "item_id", "id", "run_id")


# Facts and numbers


@query("""
SELECT * FROM (SELECT item_id, 'hn.points' AS kind, TRY_CAST(json_extract_string(facts, '$.hn.points') AS BIGINT) AS value, item_id || ':hn:points' AS source_id FROM news_items
 UNION ALL SELECT item_id, 'hn.comments', TRY_CAST(json_extract_string(facts, '$.hn.num_comments') AS BIGINT), item_id || ':hn:num_comments' FROM news_items
 UNION ALL SELECT item_id, 'github.stars', TRY_CAST(json_extract_string(facts, '$.github.stars') AS BIGINT), item_id || ':github:stars' FROM news_items
 UNION ALL SELECT item_id, 'github.forks', TRY_CAST(json_extract_string(facts, '$.github.forks') AS BIGINT), item_id || ':github:forks' FROM news_items) WHERE value IS NOT NULL
""")
def facts_extract(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "news_items").where("facts is not null").select("item_id", F.explode(facts.extract_facts(F.col("item_id"), F.col("facts"))).alias("f"))
    return rows.select("item_id", "f.kind", "f.value", "f.source_id")


@query("""
WITH f AS (SELECT url, arg_min(facts, raw_id) AS a, arg_max(facts, raw_id) AS b FROM raw_items WHERE facts IS NOT NULL AND url IS NOT NULL GROUP BY url),
k AS (SELECT url, unnest(list_distinct(list_concat(json_keys(a), json_keys(b)))) AS key, a, b FROM f)
SELECT url, key, coalesce(json_extract(b, '$.' || key), json_extract(a, '$.' || key))::VARCHAR LIKE '{%' AS is_object, list_contains(json_keys(b), key) AS from_new FROM k
""")
def facts_merge(s: SparkSession, d: str) -> DataFrame:
    """First and last facts of an address merged by top-level key, the last winning."""
    r = table(s, d, "raw_items").where("facts is not null and url is not null").groupBy("url").agg(F.min_by("facts", "raw_id").alias("a"), F.max_by("facts", "raw_id").alias("b"))
    rows = r.select("url", "b", F.explode(facts.merged(F.col("a"), F.col("b"))).alias("key", "value"))
    return rows.select("url", "key", F.startswith("value", F.lit("{")).alias("is_object"), F.map_contains_key(facts.as_map(F.col("b")), F.col("key")).alias("from_new"))


@query(r"""
WITH n AS (SELECT id, list_transform(regexp_extract_all(coalesce(headline, ''), '(?:^|[^\p{L}\p{M}\p{N}\p{Pc}{\x{200c}\x{200d}])(\p{Nd}[\p{Nd},.]*%?)', 1), lambda x: x) AS found FROM summaries)
SELECT id, array_to_string(found, ' ') AS found FROM n
""")
def bare_numbers(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "summaries").select("id", F.array_join(numbers.bare_numbers(F.col("headline")), " ").alias("found"))


_NUMBER = r"(?:^|[^\p{L}\p{M}\p{N}\p{Pc}{\x{200c}\x{200d}])(\p{Nd}[\p{Nd},.]*%?)"


@query(rf"""
WITH j AS (SELECT s.id, regexp_extract_all(coalesce(tldr_rendered, ''), '{_NUMBER}', 1) AS said, list_transform(regexp_extract_all(concat_ws(' ', n.title, n.content), '{_NUMBER}', 1), lambda x: rtrim(replace(x, ',', ''), '.')) AS held FROM summaries s JOIN news_items n USING (item_id)),
u AS (SELECT id, unnest(said) AS flagged, held FROM j)
SELECT DISTINCT id, flagged FROM u WHERE NOT list_contains(held, rtrim(replace(flagged, ',', ''), '.'))
""")
def unsourced_numbers(s: SparkSession, d: str) -> DataFrame:
    """Numbers of a card's text that its item doesn't hold."""
    n = table(s, d, "news_items").select("item_id", F.concat_ws(" ", "title", "content").alias("source_text"))
    j = table(s, d, "summaries").select("id", "item_id", "tldr_rendered").join(n, "item_id")
    return j.select("id", F.explode(numbers.unsourced_numbers(F.col("tldr_rendered"), F.col("source_text"))).alias("flagged"))


@query()
def scrubbed_texts(s: SparkSession, d: str) -> DataFrame:
    """Card texts with unsourced numbers marked."""
    n = table(s, d, "news_items").select("item_id", F.concat_ws(" ", "title", "content").alias("source_text"))
    j = table(s, d, "summaries").select("id", "item_id", "tldr_rendered").join(n, "item_id")
    return j.select("id", numbers.scrub_numbers(F.col("tldr_rendered"), F.col("source_text")).alias("shown"))


@query()
def risky_claims(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "news_items").select("item_seq", F.array_join(numbers.risky_claims(F.concat_ws(" ", "title", "content")), "; ").alias("claims")).where("claims <> ''")


@query("""
WITH f AS (SELECT item_id, TRY_CAST(json_extract_string(facts, '$.hn.points') AS BIGINT) AS p, TRY_CAST(json_extract_string(facts, '$.github.stars') AS BIGINT) AS g FROM news_items)
SELECT item_id, coalesce(p::VARCHAR, '[待核实]') || ' points, ' || coalesce(g::VARCHAR, '[待核实]') || ' stars, [待核实]' AS shown, CASE WHEN p IS NULL AND g IS NULL THEN 'F1 F2 F3' WHEN p IS NULL THEN 'F1 F3' WHEN g IS NULL THEN 'F2 F3' ELSE 'F3' END AS unresolved FROM f
""")
def token_render(s: SparkSession, d: str) -> DataFrame:
    """Placeholders replaced by stored facts; what has none is marked and named."""
    n = table(s, d, "news_items").select("item_id", facts.number(F.col("facts"), "hn", "points").cast("string").alias("p"), facts.number(F.col("facts"), "github", "stars").cast("string").alias("g"))
    values = F.map_from_entries(F.filter(F.array(F.struct(F.lit("F1").alias("k"), F.col("p").alias("v")), F.struct(F.lit("F2").alias("k"), F.col("g").alias("v"))), lambda e: e["v"].isNotNull()))
    v = numbers.verified(F.lit("{F1} points, { F2 } stars, {F3}"), values, F.lit(""), F.lit(9), 2)
    return n.select("item_id", v["rendered"].alias("shown"), F.array_join(v["unresolved"], " ").alias("unresolved"))


# Text


@query(rf"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]+>', ' ', 'g'), 'https?://[^\s\x0b\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'), '{_SPACE}', ' ', 'g')) AS clean FROM documents WHERE NOT contains(coalesce(text, ''), '&')")
def clean_text(s: SparkSession, d: str) -> DataFrame:
    """Cleaned texts of documents that need no unescaping (SQL has none); `clean_all_text` has all."""
    return table(s, d, "documents").where(~F.contains(F.coalesce("text", F.lit("")), F.lit("&"))).select("doc_id", text.clean_text(F.col("text")).alias("clean"))


@query()
def clean_all_text(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", text.clean_text(F.col("text")).alias("clean"))


@query()
def body_beyond_title(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "news_items")
    return n.select("item_seq", text.body_beyond_title(F.col("content"), F.col("title")).alias("beyond"))


@query(rf"""
SELECT DISTINCT id, e AS entity FROM (SELECT id, rtrim(ltrim(lower(unnest(regexp_extract_all(coalesce(headline, ''), '[A-Za-z][A-Za-z0-9.&\-]{{2,}}'))), '.'), '.') AS e, unnest(regexp_extract_all(coalesce(headline, ''), '[A-Za-z][A-Za-z0-9.&\-]{{2,}}')) AS t FROM summaries)
WHERE regexp_matches(t, '^[A-Z]') AND e <> '' AND e NOT IN ({", ".join(f"'{w}'" for w in text.ENTITY_STOP)})
""")
def salient_entities(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "summaries").select("id", F.explode(text.salient_entities(F.col("headline"))).alias("entity"))


@query("SELECT source, lower(trim(source)) AS family, count(*) AS n FROM raw_items WHERE source IS NOT NULL AND NOT regexp_matches(lower(source), 'google[-_ ]?news') GROUP BY ALL")
def source_families(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "raw_items").where("source is not null").groupBy("source", text.source_family(F.col("source")).alias("family")).agg(F.count("*").alias("n"))
    return r.where("family <> 'google-news'")


@query()
def subject_closeness(s: SparkSession, d: str) -> DataFrame:
    """How close a card's headline is to its cluster's title."""
    c = table(s, d, "clusters").select("cluster_id", "title")
    j = table(s, d, "summaries").select("id", "cluster_id", "headline").join(c, "cluster_id")
    return j.select("id", F.round(text.subject_closeness(F.col("headline"), F.col("title")), 6).alias("closeness"))


# Vectors


@query("""
WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))
SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 6) AS similarity FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) DESC, vec_id LIMIT 20
""")
def cosine_topk(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    q = e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q_"))
    joined = e.join(F.broadcast(q))  # one row
    return similarity.recall(joined, F.col("q_"), "embedding", 20, ties="vec_id").select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.35")
def cosine_pairs(s: SparkSession, d: str) -> DataFrame:
    return similarity.pairs_at_least(table(s, d, "embeddings"), "vec_id", "embedding", 0.35).withColumn("cosine", F.round("cosine", 6))


@query("""
SELECT a.vec_id, count(DISTINCT b.label) AS heat FROM embeddings a JOIN embeddings b ON a.vec_id = b.vec_id OR list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.35 GROUP BY a.vec_id
""")
def heat_sources(s: SparkSession, d: str) -> DataFrame:
    return similarity.heat(table(s, d, "embeddings"), "vec_id", "embedding", "label", 0.35)


@query("""
WITH RECURSIVE e AS (SELECT a.vec_id a, b.vec_id b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.45),
r(v, w) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.w)
SELECT v AS id, min(w) AS root FROM r GROUP BY v
""")
def same_event_components(s: SparkSession, d: str) -> DataFrame:
    return similarity.components(similarity.pairs_at_least(table(s, d, "embeddings"), "vec_id", "embedding", 0.45).select("a", "b"))


@query("""
WITH c AS (SELECT label, list_transform(range(1, 1 + len(any_value(embedding))), lambda i: i) AS idx FROM embeddings GROUP BY label),
m AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM (SELECT e.label, e.embedding, unnest(c.idx) AS i FROM embeddings e JOIN c USING (label)) GROUP BY ALL)
SELECT label, count(*) AS dims, round(sqrt(sum(x * x)), 6) AS length FROM m GROUP BY label
""")
def centroids(s: SparkSession, d: str) -> DataFrame:
    """Mean vector of each label: its size and length."""
    m = table(s, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return m.groupBy("label").agg(F.count("*").alias("dims"), F.round(F.sqrt(F.sum(F.col("x") * F.col("x"))), 6).alias("length"))


@query()
def leader_clusters(s: SparkSession, d: str) -> DataFrame:
    """Items with the leader of their cluster: same fingerprint, else the nearest earlier item within three days."""
    v = table(s, d, "item_vectors").where("embedding is not null").groupBy("item_id", F.size("embedding").alias("n")).agg(F.min_by("embedding", "vec_id").alias("embedding")).where("n = 64")
    n = table(s, d, "news_items").select("item_seq", "item_id", "published_at", ids.content_fingerprint(F.col("title"), F.col("content")).alias("fp")).join(v, "item_id")
    dated = n.where("published_at is not null").withColumn("t", F.unix_micros("published_at") / 1e6)
    pairs = similarity.pairs_at_least(dated, "item_seq", "embedding", 0.87, ("t", 72 * 3600.0))
    return similarity.roots(similarity.leader_parents(n, pairs, "item_seq", "published_at", "fp"), "item_seq")


# Selection


@query("""
WITH RECURSIVE s AS (SELECT n.item_seq, s.board_domain AS board, n.category AS category, s.id AS source, coalesce(length(n.content), 0) AS score FROM news_items n JOIN sources s ON n.source = s.id WHERE s.board_domain IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY board ORDER BY score DESC, item_seq) AS pos FROM s),
f AS (SELECT board, 0::BIGINT AS pos, []::VARCHAR[] AS cats, []::VARCHAR[] AS srcs, []::BIGINT[] AS kept FROM (SELECT DISTINCT board FROM o)
 UNION ALL SELECT f.board, o.pos, CASE WHEN t.ok THEN list_append(f.cats, coalesce(o.category, '')) ELSE f.cats END, CASE WHEN t.ok THEN list_append(f.srcs, o.source) ELSE f.srcs END, CASE WHEN t.ok THEN list_append(f.kept, o.item_seq) ELSE f.kept END
  FROM f JOIN o ON o.board = f.board AND o.pos = f.pos + 1, LATERAL (SELECT len(f.kept) < 20 AND len(list_filter(f.cats, lambda c: c = coalesce(o.category, ''))) < 8 AND len(list_filter(f.srcs, lambda c: c = o.source)) < 2 AS ok) t)
SELECT board, u.item_seq, u.rank FROM (SELECT board, arg_max(kept, pos) AS kept FROM f GROUP BY board), LATERAL (SELECT unnest(kept) AS item_seq, unnest(range(1, len(kept) + 1)) AS rank) u
""")
def board_quota_topk(s: SparkSession, d: str) -> DataFrame:
    """Twenty longest items of each board, eight of a category and two of a source at most."""
    src = table(s, d, "sources").where("board_domain is not null").select(F.col("id").alias("source"), F.col("board_domain").alias("board"))
    n = table(s, d, "news_items").select("item_seq", "source", F.coalesce("category", F.lit("")).alias("category"), F.coalesce(F.length("content"), F.lit(0)).alias("score")).join(src, "source")
    return selection.quota_fold(n, "board", "item_seq", "score", {"category": 8, "source": 2}, 20).select("board", "item_seq", F.col("rank").cast("long").alias("rank"))


@query()
def diverse_headlines(s: SparkSession, d: str) -> DataFrame:
    """Newest headlines of each interest of which no two share a name."""
    live = table(s, d, "summaries").where("pruned_at is null").select("interest_key", "id", F.unix_micros("created_at").alias("score"), text.salient_entities(F.col("headline")).alias("names"))
    return selection.diverse_fold(live, "interest_key", "id", "score", "names", 15)


@query("""
WITH r AS (SELECT n.item_seq, s.board_domain, coalesce(length(n.content), 0) AS score, n.content FROM news_items n JOIN sources s ON n.source = s.id),
k AS (SELECT *, row_number() OVER (PARTITION BY board_domain ORDER BY score DESC, item_seq) AS rn FROM r)
SELECT item_seq, CASE WHEN rn > 100 THEN false WHEN content IS NULL THEN true ELSE contains(content, '1') END AS kept FROM k
""")
def gate_head(s: SparkSession, d: str) -> DataFrame:
    """A gate over each board's head: a failed vote keeps, the tail is dropped."""
    src = table(s, d, "sources").select(F.col("id").alias("source"), "board_domain")
    n = table(s, d, "news_items").select("item_seq", "source", F.coalesce(F.length("content"), F.lit(0)).alias("score"), "content").join(src, "source")
    votes = n.select("item_seq", F.contains("content", F.lit("1")).alias("vote"))
    return selection.through_gate(n, votes, selection.Gate(votes=1, on_error=True, tail=False, head=100), "board_domain", "item_seq", "score").select("item_seq", "kept")


@query("""
SELECT n.item_seq, round(0.2 * coalesce(s.weight, 0.5) + 0.2 * CASE WHEN n.published_at IS NULL THEN 0 ELSE greatest(0, 1 - (epoch_us(TIMESTAMPTZ '2026-03-10 00:00:00+00') - epoch_us(n.published_at)) / 3.6e9 / coalesce(s.freshness_hours, 24)) END + 0.1 * least(coalesce(c.source_count, 1) / 3, 1), 6) AS score
FROM news_items n LEFT JOIN sources s ON n.source = s.id LEFT JOIN clusters c ON n.cluster_id = c.cluster_id
""")
def rule_score(s: SparkSession, d: str) -> DataFrame:
    """Weighted sum of source weight, recency and corroboration."""
    n = table(s, d, "news_items").select("item_seq", "source", "cluster_id", "published_at")
    n = n.join(table(s, d, "sources").select(F.col("id").alias("source"), "weight", "freshness_hours"), "source", "left").join(table(s, d, "clusters").select("cluster_id", "source_count"), "cluster_id", "left")
    recency = F.coalesce(F.greatest(F.lit(0.0), 1 - moments.age_hours(F.col("published_at"), _now()) / F.coalesce("freshness_hours", F.lit(24))), F.lit(0.0))
    return n.select("item_seq", F.round(0.2 * F.coalesce("weight", F.lit(0.5)) + 0.2 * recency + 0.1 * F.least(F.coalesce("source_count", F.lit(1)) / 3, F.lit(1.0)), 6).alias("score"))


@query()
def event_ranking(s: SparkSession, d: str) -> DataFrame:
    """Each board's ten events, from clusters to quotas."""
    v = table(s, d, "item_vectors").where("embedding is not null and size(embedding) = 64").groupBy("item_id").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return ranking.rank_events(table(s, d, "news_items"), table(s, d, "sources"), v, _now())


@query("""
WITH c AS (SELECT n.item_seq, m.matcher AS board, count(*) AS n FROM match_pairs m JOIN news_items n ON n.item_id = m.left_id WHERE m.score >= 0.6 AND m.matcher IN ('vector', 'title', 'url') GROUP BY ALL)
SELECT item_seq, board FROM (SELECT *, row_number() OVER (PARTITION BY item_seq ORDER BY n DESC, board DESC) AS rn FROM c WHERE n >= 2) WHERE rn = 1
""")
def label_votes(s: SparkSession, d: str) -> DataFrame:
    """Labels with two confident votes at least; all else has none."""
    n = table(s, d, "news_items").select("item_seq", F.col("item_id").alias("left_id"))
    votes = table(s, d, "match_pairs").join(n, "left_id").select("item_seq", F.col("matcher").alias("board"), "score")
    return selection.majority_label(votes, "item_seq", "board", 2, ["vector", "title", "url"], "score", 0.6)


@query("""
WITH c AS (SELECT DISTINCT sha256(coalesce(tldr_rendered, '')) AS hash FROM summaries WHERE run_id < 'daily_20260301')
SELECT s.id, c.hash IS NOT NULL AS cached, contains(coalesce(s.tldr_rendered, ''), 'a') AS vote FROM summaries s LEFT JOIN c ON c.hash = sha256(coalesce(s.tldr_rendered, '')) WHERE s.run_id >= 'daily_20260301'
""")
def cached_verdicts(s: SparkSession, d: str) -> DataFrame:
    """Verdicts on texts, of which those judged in earlier runs aren't asked again."""
    cards = table(s, d, "summaries")
    old = cards.where("run_id < 'daily_20260301'").select(F.sha2(F.coalesce("tldr_rendered", F.lit("")), 256).alias("hash"), F.contains(F.coalesce("tldr_rendered", F.lit("")), F.lit("a")).alias("vote")).distinct()
    new = cards.where("run_id >= 'daily_20260301'").select("id", F.coalesce("tldr_rendered", F.lit("")).alias("t"))
    told = selection.judge(new, "id", "t", lambda t: "a" in t, old)
    return told.join(old.select("hash", F.lit(True).alias("cached")), "hash", "left").select("id", F.coalesce("cached", F.lit(False)).alias("cached"), "vote")


@query("""
WITH w AS (SELECT DISTINCT interest_key, unnest(string_split(lower(headline), ' ')) AS word FROM summaries WHERE pruned_at IS NULL AND headline IS NOT NULL),
o AS (SELECT word, min(interest_key) AS a, max(interest_key) AS b FROM w WHERE word <> '' GROUP BY word)
SELECT word, a = b AS one_board FROM o
""")
def words_across_boards(s: SparkSession, d: str) -> DataFrame:
    """Words of live headlines, and whether one board alone uses them."""
    w = table(s, d, "summaries").where("pruned_at is null and headline is not null").select("interest_key", F.explode(F.split(F.lower("headline"), " ")).alias("word")).where("word <> ''")
    return w.groupBy("word").agg((F.min("interest_key") == F.max("interest_key")).alias("one_board"))


@query("""
SELECT item_id, id FROM (SELECT s.item_id, s.id, row_number() OVER (PARTITION BY s.item_id ORDER BY s.created_at, s.id) AS rn FROM summaries s WHERE s.cluster_id IS NOT NULL
 AND s.cluster_id NOT IN (SELECT cluster_id FROM summaries WHERE run_id < 'daily_20260210' AND cluster_id IS NOT NULL)) WHERE rn = 1
""")
def not_yet_linked(s: SparkSession, d: str) -> DataFrame:
    """First cards of items whose cluster no earlier run has linked."""
    cards = table(s, d, "summaries").where("cluster_id is not null")
    linked = cards.where("run_id < 'daily_20260210'").select("cluster_id").distinct()
    left = cards.join(linked, "cluster_id", "left_anti")
    return left.groupBy("item_id").agg(F.min_by("id", F.struct("created_at", "id")).alias("id"))


# Stories over days


@query("""
SELECT event_id, round((value - lag(value) OVER w) / greatest((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 86400e6, 1), 6) AS rate FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)
""")
def snapshot_rates(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("series", F.concat_ws(":", "user_id", "event_type"))
    return stories.rate_between_snapshots(e, "series", "ts", "event_id", "value").select("event_id", F.round("rate", 6).alias("rate"))


@query("""
SELECT cluster_id, count(DISTINCT day) AS days, min(day) AS first_date, max(day) AS last_date, count(*) AS n FROM (SELECT cluster_id, strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS day FROM summaries WHERE cluster_id IS NOT NULL AND pruned_at IS NULL) GROUP BY cluster_id HAVING count(DISTINCT day) >= 2
""")
def story_timelines(s: SparkSession, d: str) -> DataFrame:
    live = table(s, d, "summaries").where("pruned_at is null and cluster_id is not null").withColumn("day", F.date_format("created_at", "yyyy-MM-dd"))
    return stories.timelines(live, "cluster_id", "day", ["id", "headline"], 2).select("cluster_id", "days", "first_date", "last_date", "n")


@query("""
SELECT cluster_id, count(DISTINCT CASE WHEN day < '2026-03-05' THEN day END) AS days_prior, max(CASE WHEN day < '2026-03-05' THEN day END) AS last_date, bool_or(day >= '2026-03-05') AS linked_today FROM (SELECT cluster_id, strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS day FROM summaries WHERE cluster_id IS NOT NULL) WHERE day >= '2026-02-19' GROUP BY cluster_id
""")
def shown_before(s: SparkSession, d: str) -> DataFrame:
    links = table(s, d, "summaries").where("cluster_id is not null").withColumn("day", F.date_format("created_at", "yyyy-MM-dd"))
    return stories.shown_ledger(links, "cluster_id", "day", "headline", "2026-03-05", "2026-02-19").select("cluster_id", "days_prior", "last_date", "linked_today")


@query("SELECT cluster_id, CASE WHEN last_seen_at < TIMESTAMPTZ '2026-03-03 00:00:00+00' THEN 'dormant' ELSE 'active' END AS status FROM clusters")
def dormancy(s: SparkSession, d: str) -> DataFrame:
    return stories.dormant(table(s, d, "clusters").select("cluster_id", "last_seen_at", F.lit("active").alias("status")), "last_seen_at", "status", _now(), 7).select("cluster_id", "status")


@query()
def story_assignment(s: SparkSession, d: str) -> DataFrame:
    """Each day's live cards put to running stories of their interest, in order."""
    live = table(s, d, "summaries").where("pruned_at is null").withColumn("day", F.concat_ws("/", "interest_key", "run_id")).withColumn("subject", F.array_join(text.salient_entities(F.col("headline")), " "))
    return stories.assign_to_stories(live.select("day", "id", "subject"), "day", [], "id", "subject")


@query("SELECT id, CAST(substr(run_id, 7, 4) || '-' || substr(run_id, 11, 2) || '-' || substr(run_id, 13, 2) AS VARCHAR) AS day FROM summaries WHERE run_id LIKE 'daily_%'")
def logical_dates(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "summaries").where("run_id like 'daily\\_%'").select("id", moments.logical_date(F.col("run_id"), F.col("created_at"), "Asia/Shanghai").alias("day"))


# Archive and checks


@query("""
SELECT progress_date AS date, count(*) AS n, array_to_string(list_sort(list_distinct(list(category) FILTER (category IS NOT NULL))), ',') AS labels, arg_min(doc_id, doc_id) AS top FROM documents WHERE progress_date IS NOT NULL GROUP BY progress_date
""")
def archive_index(s: SparkSession, d: str) -> DataFrame:
    """Items, labels and first item of each day."""
    rows = table(s, d, "documents").where("progress_date is not null").withColumnRenamed("progress_date", "date")
    return archive.day_index(rows, "category", "doc_id", "doc_id").select("date", "n", F.array_join("labels", ",").alias("labels"), F.col("top_headline").alias("top"))


@query("""
WITH m AS (SELECT avg(enabled::INT) AS enabled, avg((region IS NOT NULL)::INT) AS has_region, count(DISTINCT id) / count(*) AS unique_ids, avg((weight BETWEEN 0 AND 1)::INT) AS weights_in_range FROM sources),
t AS (SELECT 'enabled' AS "check", enabled AS v, 0.9::DOUBLE AS threshold, 0.5 AS f FROM m UNION ALL SELECT 'has_region', has_region, 0.9, 0.5 FROM m UNION ALL SELECT 'unique_ids', unique_ids, 1.0, 1.0 FROM m UNION ALL SELECT 'weights_in_range', weights_in_range, 1.0, 0.99 FROM m)
SELECT "check", round(v, 6) AS value, threshold, CASE WHEN v IS NULL THEN 'ungraded' WHEN v >= threshold THEN 'ok' WHEN v >= f THEN 'warn' ELSE 'fail' END AS level FROM t
""")
def registry_quality(s: SparkSession, d: str) -> DataFrame:
    return quality.registry_checks(table(s, d, "sources"))


@query()
def card_quality(s: SparkSession, d: str) -> DataFrame:
    return quality.card_checks(table(s, d, "summaries"))


@query("SELECT interest_key, count(*) AS n FROM (SELECT interest_key, row_number() OVER (PARTITION BY interest_key ORDER BY id) AS rn FROM summaries WHERE pruned_at IS NULL) WHERE rn <= 12 GROUP BY interest_key")
def digest_messages(s: SparkSession, d: str) -> DataFrame:
    """Lines of each interest's message, twelve at most."""
    live = table(s, d, "summaries").where("pruned_at is null")
    made = archive.digest_lines(live, "interest_key", "id", "headline", "produced_by")
    return made.select("interest_key", F.size(F.split("body", "\n")).cast("long").alias("n"))


@query("""
WITH q AS (SELECT embedding AS q FROM item_vectors WHERE vec_id = (SELECT min(vec_id) FROM item_vectors WHERE embedding IS NOT NULL AND len(embedding) = 64)),
t AS (SELECT v.vec_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.q::DOUBLE[]), 6) AS similarity FROM item_vectors v, q WHERE len(v.embedding) = 64 AND list_sum(list_transform(v.embedding, lambda x: x * x)) > 0 ORDER BY list_cosine_similarity(v.embedding::DOUBLE[], q.q::DOUBLE[]) DESC, vec_id LIMIT 25)
SELECT * FROM t WHERE similarity >= 0.4
""")
def cards_recall_floor(s: SparkSession, d: str) -> DataFrame:
    """Answers to one question's vector: the limit first, then the floor."""
    v = table(s, d, "item_vectors").where("embedding is not null and size(embedding) = 64")
    q = v.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q_"))
    some = v.where("exists(embedding, x -> x <> 0)").join(F.broadcast(q))  # one row
    return similarity.recall(some, F.col("q_"), "embedding", 25, 0.4, "vec_id").select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("SELECT (row_number() OVER (ORDER BY id) - 1) // 6 AS chunk, id FROM summaries WHERE pruned_at IS NULL AND review_state = 'ok' AND run_id = (SELECT max(run_id) FROM summaries)")
def chunks_of_six(s: SparkSession, d: str) -> DataFrame:
    """The last run's cards in batches of six; one run's cards are few and numbered in one order."""
    live = table(s, d, "summaries").where("pruned_at is null and review_state = 'ok'").select("id", "run_id")
    last = table(s, d, "summaries").agg(F.max("run_id").alias("run_id"))
    return live.join(F.broadcast(last), "run_id").select(F.floor((F.row_number().over(Window.orderBy("id")) - 1) / 6).alias("chunk"), "id")


# Streams


@query("SELECT event_type, epoch_us(date_trunc('hour', ts)) AS hour_us, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def stream_windows(s: SparkSession, d: str) -> DataFrame:
    """Hourly sums by a streaming query over the events, run until the input is used up."""
    return front.hourly(s, d).select("event_type", "hour_us", "n", F.round("total", 2).alias("total"))


@query("SELECT min(event_id) AS event_id, user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events GROUP BY user_id, event_type, k")
def stream_first_seen(s: SparkSession, d: str) -> DataFrame:
    """The first event of each key by a streaming deduplication."""
    return front.first_seen(s, d)


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), n AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM n GROUP BY user_id, k
""")
def sessions(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return e.groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n")).select("user_id", F.unix_micros("session_window.start").alias("start_us"), "n")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
