"""Further queries of the core operators: candidates, boards, running stories, deliveries and parsed payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dispatchlake.functions import facts, text
from dispatchlake.functions.tables import table
from dispatchlake.operators import candidates, delivery
from dispatchlake.plans.queries import _now, query

_SPACE = r"[\s\x0b\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


# Pools and boards


@query("SELECT item_seq FROM news_items WHERE source IS NULL OR source NOT IN (SELECT id FROM sources WHERE NOT enabled OR board_only)")
def allowed_members(s: SparkSession, d: str) -> DataFrame:
    """Members of events: no item of a disabled source or of one that has its own board only."""
    out = table(s, d, "sources").where("not enabled or board_only").select(F.col("id").alias("source"))
    return table(s, d, "news_items").join(F.broadcast(out), "source", "left_anti").select("item_seq")


@query("""
SELECT item_id, url, TRY_CAST(json_extract_string(facts, '$.github.stars') AS BIGINT) AS stars FROM news_items
WHERE TRY_CAST(json_extract_string(facts, '$.github.stars') AS BIGINT) IS NOT NULL AND published_at >= TIMESTAMPTZ '2026-01-01 00:00:00+00' AND source IN (SELECT id FROM sources WHERE enabled) AND regexp_matches(lower(source), 'ai|llm|agent')
ORDER BY stars DESC, item_id LIMIT 200
""")
def project_pool(s: SparkSession, d: str) -> DataFrame:
    """The two hundred starred projects of active sources; the limit is the feature."""
    active = table(s, d, "sources").where("enabled").select(F.col("id").alias("source"))
    return delivery.project_pool(table(s, d, "news_items"), active, F.lit("2026-01-01T00:00:00Z").cast("timestamp")).select("item_id", "url", "stars")


@query("""
WITH p AS (SELECT item_id, TRY_CAST(json_extract_string(facts, '$.github.stars') AS BIGINT) AS stars, lower(regexp_extract(url, '^https?://([^/]+)/', 1) || '/' || regexp_extract(url, '/([^/]+)$', 1)) AS project FROM news_items WHERE url IS NOT NULL),
o AS (SELECT DISTINCT project FROM summaries JOIN p USING (item_id))
SELECT project, max(stars) AS stars, count(*) AS n FROM p WHERE stars IS NOT NULL AND project NOT IN (SELECT project FROM o) GROUP BY project
""")
def projects_on_no_other_board(s: SparkSession, d: str) -> DataFrame:
    """Projects with stars that no card of another board shows; the tables' addresses stand for those of projects."""
    home = F.concat(F.lit("https://github.com/"), F.regexp_extract("url", "^https?://([^/]+)/", 1), F.lit("/"), F.regexp_extract("url", "/([^/]+)$", 1))
    n = table(s, d, "news_items").where("url is not null").select("item_id", text.repo_key(home).alias("project"), facts.number(F.col("facts"), "github", "stars").alias("stars"))
    shown = table(s, d, "summaries").select("item_id").join(n, "item_id").where("project is not null").select("project").distinct()
    return n.where("project is not null and stars is not null").join(shown, "project", "left_anti").groupBy("project").agg(F.max("stars").alias("stars"), F.count("*").alias("n"))


@query("SELECT DISTINCT n.url FROM summaries s JOIN news_items n USING (item_id) WHERE s.interest_key <> 'int_3fa1c09be772' AND n.url IS NOT NULL")
def urls_of_other_boards(s: SparkSession, d: str) -> DataFrame:
    cards = table(s, d, "summaries").where("interest_key <> 'int_3fa1c09be772'").select("item_id").distinct()
    return table(s, d, "news_items").where("url is not null").join(cards, "item_id", "left_semi").select("url").distinct()


@query("SELECT DISTINCT board_domain FROM sources WHERE board_domain IN (SELECT r.board_domain FROM sources r JOIN news_items n ON n.source = r.id JOIN summaries s USING (item_id) WHERE s.pruned_at IS NULL)")
def domains_with_cards(s: SparkSession, d: str) -> DataFrame:
    live = table(s, d, "summaries").where("pruned_at is null").select("item_id").distinct()
    held = table(s, d, "news_items").join(live, "item_id", "left_semi").select(F.col("source").alias("id")).distinct()
    return table(s, d, "sources").where("board_domain is not null").join(held, "id", "left_semi").select("board_domain").distinct()


@query("""
SELECT cluster_id FROM news_items n JOIN sources s ON n.source = s.id WHERE cluster_id IS NOT NULL AND s.board_domain IN ('ai', 'bio', 'geo')
UNION SELECT cluster_id FROM news_items n JOIN sources s ON n.source = s.id WHERE cluster_id IS NOT NULL AND s.mixed
""")
def selected_clusters(s: SparkSession, d: str) -> DataFrame:
    """Clusters of the boards' sources together with those of mixed sources."""
    src = table(s, d, "sources").select(F.col("id").alias("source"), "board_domain", "mixed")
    n = table(s, d, "news_items").where("cluster_id is not null").select("source", "cluster_id").join(F.broadcast(src), "source")
    return n.where(F.col("board_domain").isin("ai", "bio", "geo")).select("cluster_id").union(n.where("mixed").select("cluster_id")).distinct()


# Candidates


@query(r"""
WITH c AS (SELECT cluster_id, list_distinct(list_filter(list_transform(string_split(trim(regexp_replace(lower(title), '""" + _SPACE + r"""', ' ', 'g')), ' '), lambda w: regexp_replace(w, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')), lambda w: w <> '')) AS t FROM clusters WHERE title IS NOT NULL),
e AS (SELECT cluster_id, len(t) AS n, unnest(t) AS w FROM c), p AS (SELECT a.cluster_id AS a, b.cluster_id AS b, count(*) AS k, any_value(a.n) AS n, any_value(b.n) AS m FROM e a JOIN e b ON a.w = b.w AND a.cluster_id < b.cluster_id GROUP BY ALL),
f AS (SELECT a, b FROM p WHERE k = least(n, m) OR k / (n + m - k) >= 0.3)
SELECT a, b, rn AS place FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY b) AS rn FROM f) WHERE rn <= 8
""")
def title_candidates(s: SparkSession, d: str) -> DataFrame:
    """For each cluster up to eight later ones whose titles share three tenths of their words."""
    c = table(s, d, "clusters").where("title is not null").select("cluster_id", "title").withColumn("t", F.array_distinct(F.filter(F.transform(F.split(text.folded(F.lower("title")), " "), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")), lambda w: w != "")))
    return candidates.first_close(c, "cluster_id", "t", 0.3, 8)


@query("""
WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c, a.label = b.label AS lex FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id),
q AS (SELECT a, b, CASE WHEN lex THEN 1.0 ELSE c END AS score FROM p WHERE lex OR c >= 0.3), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS place FROM q)
SELECT a, b, round(score, 6) AS score, place FROM (SELECT *, row_number() OVER (ORDER BY a, place) AS pos FROM r WHERE place <= 8) WHERE pos <= 800
""")
def surfaced_pairs(s: SparkSession, d: str) -> DataFrame:
    """Candidate pairs by subject or vector: eight a row, eight hundred in all (both limits are the operator's)."""
    e = table(s, d, "embeddings")
    return candidates.surface_candidates(e, "vec_id", F.concat(F.lit("label "), F.col("label").cast("string")), "embedding", 0.5001, 0.3, 8, 800).select("a", "b", F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


@query("""
WITH RECURSIVE h AS (SELECT a.vec_id, count(DISTINCT b.label) AS heat FROM embeddings a JOIN embeddings b ON a.vec_id = b.vec_id OR list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.35 GROUP BY a.vec_id),
o AS (SELECT vec_id, heat, embedding, row_number() OVER (ORDER BY heat DESC, vec_id) AS pos FROM h JOIN embeddings USING (vec_id) WHERE heat >= 2),
near AS (SELECT a.pos, list(b.vec_id) AS l FROM o a JOIN o b ON b.pos < a.pos AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.35 GROUP BY a.pos),
q AS (SELECT o.vec_id, o.pos, coalesce(l, []) AS l FROM o LEFT JOIN near USING (pos)),
f AS (SELECT 0::BIGINT AS pos, []::BIGINT[] AS kept UNION ALL SELECT q.pos, CASE WHEN len(f.kept) < 30 AND NOT list_has_any(f.kept, q.l) THEN list_append(f.kept, q.vec_id) ELSE f.kept END FROM f JOIN q ON q.pos = f.pos + 1)
SELECT u.vec_id, u.place FROM (SELECT arg_max(kept, pos) AS kept FROM f), LATERAL (SELECT unnest(kept) AS vec_id, unnest(range(1, len(kept) + 1)) AS place) u
""")
def hot_representatives(s: SparkSession, d: str) -> DataFrame:
    """Hottest vectors of which none is near another, thirty at most."""
    from dispatchlake.operators import similarity

    e = table(s, d, "embeddings")
    heat = similarity.heat(e, "vec_id", "embedding", "label", 0.35)
    hot = e.join(heat, "vec_id")
    return candidates.hot_representatives(hot, "vec_id", "heat", "embedding", 0.35, 2, 30).select("vec_id", F.col("place").cast("long").alias("place"))


@query("""
WITH h AS (SELECT item_id, least(count(*), 5) AS heat FROM match_pairs m JOIN news_items n ON n.item_id = m.left_id WHERE m.is_same GROUP BY item_id)
SELECT s.item_id, greatest(1, max(coalesce(c.source_count, 1)), max(coalesce(h.heat, 1))) AS corroboration FROM summaries s LEFT JOIN clusters c USING (cluster_id) LEFT JOIN h ON h.item_id = s.item_id WHERE s.item_id IS NOT NULL GROUP BY s.item_id
""")
def corroboration(s: SparkSession, d: str) -> DataFrame:
    """How many sources stand behind each card's item: its cluster's, or its confirmed matches."""
    m = table(s, d, "match_pairs").where("is_same").select(F.col("left_id").alias("item_id"))
    heat = m.join(table(s, d, "news_items").select("item_id"), "item_id", "left_semi").groupBy("item_id").agg(F.least(F.count("*"), F.lit(5)).alias("heat"))
    return candidates.corroboration(table(s, d, "summaries").where("item_id is not null"), table(s, d, "clusters"), heat)


@query("""
WITH t AS (SELECT label, embedding AS tv FROM embeddings WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label))
SELECT e.vec_id AS event_id, t.label AS topic, round(list_cosine_similarity(e.embedding::DOUBLE[], t.tv::DOUBLE[]), 6) AS relevance FROM embeddings e, t
""")
def topic_relevance(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    topics = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vec")).select(F.col("label").alias("topic"), "vec")
    return candidates.relevance(e.select(F.col("vec_id").alias("event_id"), F.col("embedding").alias("vec")), topics).withColumn("relevance", F.round("relevance", 6))


# Stories and deliveries


@query("""
WITH st AS (SELECT interest_key AS story_id, min(headline) AS name, count(*) AS heat, min(epoch_us(created_at)) AS f, max(epoch_us(created_at)) AS l FROM summaries WHERE run_id < 'daily_20260225' AND interest_key IS NOT NULL GROUP BY ALL),
k AS (SELECT interest_key AS story_id, arg_max(headline, struct_pack(t := created_at, h := headline)) AS newest, count(*) AS n, min(epoch_us(created_at)) AS f, max(epoch_us(created_at)) AS l FROM summaries WHERE run_id >= 'daily_20260225' AND interest_key IS NOT NULL AND headline IS NOT NULL GROUP BY ALL)
SELECT story_id, coalesce(newest, name) AS name, coalesce(heat, 0) + coalesce(n, 0) AS heat, coalesce(st.f, k.f) AS first_us, greatest(st.l, k.l) AS last_us, CASE WHEN n IS NULL THEN 'dormant' ELSE 'active' END AS status FROM st FULL JOIN k USING (story_id)
""")
def touched_stories(s: SparkSession, d: str) -> DataFrame:
    """Stories of earlier runs after the links of later ones."""
    cards = table(s, d, "summaries").where("interest_key is not null").select(F.col("interest_key").alias("story_id"), "headline", F.col("created_at").cast("timestamp").alias("seen_at"), "run_id")
    old = cards.where("run_id < 'daily_20260225'").groupBy("story_id").agg(F.min("headline").alias("name"), F.count("*").alias("heat"), F.min("seen_at").alias("first_seen_at"), F.max("seen_at").alias("last_seen_at")).withColumn("status", F.lit("dormant"))
    out = delivery.touched_stories(old, cards.where("run_id >= 'daily_20260225' and headline is not null"))
    return out.select("story_id", "name", "heat", F.unix_micros("first_seen_at").alias("first_us"), F.unix_micros("last_seen_at").alias("last_us"), "status")


@query("""
SELECT DISTINCT s.cluster_id, s.interest_key AS story_id FROM summaries s WHERE s.cluster_id IS NOT NULL AND s.interest_key IN (SELECT interest_key FROM summaries WHERE run_id >= 'daily_20260301')
""")
def tracked_clusters(s: SparkSession, d: str) -> DataFrame:
    """Clusters that hang on a story seen of late."""
    cards = table(s, d, "summaries")
    links = cards.where("cluster_id is not null").select("cluster_id", F.col("interest_key").alias("story_id"))
    active = cards.where("run_id >= 'daily_20260301' and interest_key is not null").select(F.col("interest_key").alias("story_id"), F.lit("active").alias("status")).distinct()
    return delivery.tracked(links, active)


@query("""
SELECT s.interest_key, s.run_id FROM (SELECT DISTINCT interest_key, run_id FROM summaries) s WHERE NOT exists (SELECT 1 FROM summaries d WHERE d.review_state = 'ok' AND d.interest_key = s.interest_key AND d.run_id = s.run_id) AND s.interest_key IS NOT NULL AND s.run_id IS NOT NULL
""")
def undelivered(s: SparkSession, d: str) -> DataFrame:
    """Boards' runs of which no delivery has succeeded."""
    runs = table(s, d, "summaries").where("interest_key is not null and run_id is not null").select("interest_key", "run_id", F.when(F.col("review_state") == "ok", "sent").otherwise("failed").alias("status"))
    return delivery.not_delivered(runs.select("interest_key", "run_id").distinct(), runs, ["interest_key", "run_id"])


@query("""
WITH l AS (SELECT interest_key, run_id, min(review_state) AS status FROM summaries WHERE run_id < 'daily_20260225' AND interest_key IS NOT NULL GROUP BY ALL),
n AS (SELECT interest_key, run_id, 'sent' AS status FROM summaries WHERE run_id >= 'daily_20260220' AND interest_key IS NOT NULL GROUP BY ALL)
SELECT * FROM l UNION ALL SELECT * FROM n WHERE (interest_key, run_id) NOT IN (SELECT (interest_key, run_id) FROM l)
""")
def delivery_ledger(s: SparkSession, d: str) -> DataFrame:
    """A ledger after new deliveries: a key that stands there keeps its status."""
    c = table(s, d, "summaries").where("interest_key is not null")
    ledger = c.where("run_id < 'daily_20260225'").groupBy("interest_key", "run_id").agg(F.min("review_state").alias("status"))
    return delivery.record_deliveries(ledger, c.where("run_id >= 'daily_20260220'").select("interest_key", "run_id", F.lit("sent").alias("status")), ["interest_key", "run_id"])


@query("SELECT id FROM summaries WHERE pruned_at IS NULL AND interest_key NOT IN (SELECT interest_key FROM summaries GROUP BY interest_key HAVING count(*) % 2 = 0) AND interest_key IS NOT NULL")
def shown_stories(s: SparkSession, d: str) -> DataFrame:
    """Cards of stories that a reader has not hidden (here those with an even number of cards)."""
    hidden = table(s, d, "summaries").groupBy("interest_key").count().where("count % 2 = 0").select("interest_key")
    return table(s, d, "summaries").where("pruned_at is null and interest_key is not null").join(hidden, "interest_key", "left_anti").select("id")


@query("""
WITH m AS (SELECT unnest([s.cluster_id, n.cluster_id]) AS cluster_id, s.id FROM summaries s LEFT JOIN news_items n USING (item_id)),
g AS (SELECT cluster_id, interest_key, max(run_id) AS last_run FROM summaries WHERE cluster_id IS NOT NULL GROUP BY ALL)
SELECT m.id, arg_max(g.interest_key, struct_pack(r := g.last_run, k := g.interest_key)) AS story_id FROM m JOIN g USING (cluster_id) GROUP BY m.id
""")
def latest_story_of_members(s: SparkSession, d: str) -> DataFrame:
    """The last story that any of a card's clusters was clipped in."""
    n = table(s, d, "news_items").select("item_id", F.col("cluster_id").alias("other"))
    cards = table(s, d, "summaries").select("id", "item_id", "cluster_id", "interest_key", "run_id")
    members = cards.join(n, "item_id", "left").select("id", F.explode(F.array("cluster_id", "other")).alias("cluster_id"))
    ledger = cards.where("cluster_id is not null").groupBy("cluster_id", "interest_key").agg(F.max("run_id").alias("last_run"))
    return members.join(ledger, "cluster_id").groupBy("id").agg(F.max_by("interest_key", F.struct("last_run", "interest_key")).alias("story_id"))


# Payloads and text


@query("""
SELECT item_seq, coalesce(length(f), 0) > coalesce(length(c), 0) AS from_page, greatest(coalesce(length(c), 0), coalesce(length(f), 0)) AS n FROM (SELECT item_seq, content AS c, json_extract_string(facts, '$.fulltext.text') AS f FROM news_items)
""")
def longer_body(s: SparkSession, d: str) -> DataFrame:
    """Of content and page text the one with more to it (lengths; the cleaned texts are those of `clean_all_text`)."""
    n = table(s, d, "news_items").select("item_seq", F.coalesce(F.length("content"), F.lit(0)).alias("c"), F.coalesce(F.length(F.get_json_object("facts", "$.fulltext.text")), F.lit(0)).alias("f"))
    return n.select("item_seq", (F.col("f") > F.col("c")).alias("from_page"), F.greatest("c", "f").cast("long").alias("n"))


@query("""
SELECT source, label, n FROM (SELECT n.source, coalesce(s.host, regexp_replace(n.source, '[-_]', ' ', 'g')) AS label, count(*) AS n FROM news_items n LEFT JOIN sources s ON n.source = s.id WHERE n.source IS NOT NULL GROUP BY ALL)
""")
def labelled_sources(s: SparkSession, d: str) -> DataFrame:
    src = table(s, d, "sources").select(F.col("id").alias("source"), "host")
    n = table(s, d, "news_items").where("source is not null").groupBy("source").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(src), "source", "left").select("source", F.coalesce("host", F.regexp_replace("source", "[-_]", " ")).alias("label"), "n")


@query("""
SELECT s.board_domain AS board, arg_min(left(c.headline, 16), c.id) AS top, count(DISTINCT n.source) AS sources, min(s.board_domain || ':' || c.id) AS uid FROM summaries c JOIN news_items n USING (item_id) JOIN sources s ON n.source = s.id WHERE c.pruned_at IS NULL AND c.headline IS NOT NULL AND s.board_domain IS NOT NULL GROUP BY s.board_domain
""")
def board_overview(s: SparkSession, d: str) -> DataFrame:
    """Each board's first headline, cut, and how many sources it draws on."""
    src = table(s, d, "sources").where("board_domain is not null").select(F.col("id").alias("source"), F.col("board_domain").alias("board"))
    c = table(s, d, "summaries").where("pruned_at is null and headline is not null").join(table(s, d, "news_items").select("item_id", "source"), "item_id").join(F.broadcast(src), "source")
    return c.groupBy("board").agg(F.min_by(F.substring("headline", 1, 16), "id").alias("top"), F.countDistinct("source").alias("sources"), F.min(F.concat_ws(":", "board", "id")).alias("uid"))


@query("""
WITH f AS (SELECT item_id, k.kind, k.v AS value FROM (SELECT item_id, unnest([{'kind': 'hn.points', 'v': TRY_CAST(json_extract_string(facts, '$.hn.points') AS BIGINT)}, {'kind': 'github.stars', 'v': TRY_CAST(json_extract_string(facts, '$.github.stars') AS BIGINT)}]) AS k FROM news_items WHERE item_id IN (SELECT item_id FROM summaries WHERE run_id = (SELECT max(run_id) FROM summaries))) WHERE k.v IS NOT NULL)
SELECT 'F' || row_number() OVER (ORDER BY item_id, kind) AS token, item_id, kind, value FROM f
""")
def numbered_facts(s: SparkSession, d: str) -> DataFrame:
    """Facts of the last run's items, numbered through in one order; one run's facts are few."""
    last = table(s, d, "summaries").agg(F.max("run_id").alias("run_id"))
    run = table(s, d, "summaries").join(F.broadcast(last), "run_id").select("item_id").distinct()
    n = table(s, d, "news_items").join(run, "item_id", "left_semi")
    each = n.select("item_id", F.inline(F.array(*(F.struct(F.lit(f"{a}.{b}").alias("kind"), facts.number(F.col("facts"), a, b).alias("value")) for a, b in (("hn", "points"), ("github", "stars"))))))
    return facts.numbered(each.where("value is not null"), ["item_id", "kind"]).select("token", "item_id", "kind", "value")


@query("""
SELECT id, CASE WHEN review_state = 'ok' AND length(coalesce(tldr_rendered, '')) > 0 AND id % 7 BETWEEN 1 AND 5 THEN tldr_rendered ELSE '' END AS answer, review_state = 'ok' AND length(coalesce(tldr_rendered, '')) > 0 AND id % 7 BETWEEN 1 AND 5 AS enough FROM summaries
""")
def validated_answers(s: SparkSession, d: str) -> DataFrame:
    """Replies as JSON in fences: what isn't sure, has no text or cites what isn't there counts as no answer."""
    c = table(s, d, "summaries")
    body = F.to_json(F.struct((F.col("review_state") == "ok").alias("enough"), F.coalesce("tldr_rendered", F.lit("")).alias("answer"), F.array(F.col("id") % 7).alias("used")))
    v = facts.validated_reply(F.concat(F.lit("```json\n"), body, F.lit("\n```")), F.lit(5))
    return c.select("id", v["answer"].alias("answer"), v["enough"].alias("enough"))


@query("""
SELECT interest_key, string_agg('[' || rn || '] ' || headline, chr(10) ORDER BY rn) AS evidence FROM (SELECT interest_key, coalesce(headline, '') AS headline, row_number() OVER (PARTITION BY interest_key ORDER BY id) AS rn FROM summaries WHERE pruned_at IS NULL AND interest_key IS NOT NULL) WHERE rn <= 12 GROUP BY interest_key
""")
def numbered_evidence(s: SparkSession, d: str) -> DataFrame:
    """Each interest's first twelve cards as a numbered list."""
    c = table(s, d, "summaries").where("pruned_at is null and interest_key is not null")
    top = c.withColumn("rn", F.row_number().over(Window.partitionBy("interest_key").orderBy("id"))).where("rn <= 12")
    line = F.struct("rn", F.concat(F.lit("["), F.col("rn"), F.lit("] "), F.coalesce("headline", F.lit(""))).alias("line"))
    return top.groupBy("interest_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("evidence"))


@query("""
SELECT source, round(avg((http_status IS NULL OR http_status >= 400)::INT), 6) AS failed, avg((http_status IS NULL OR http_status >= 400)::INT) >= 0.2 AS alert FROM (SELECT DISTINCT resp_id, source, http_status FROM fetch_responses) WHERE source IS NOT NULL GROUP BY source
""")
def failure_alert(s: SparkSession, d: str) -> DataFrame:
    """Share of failed polls of each source, and where it is high enough to tell someone."""
    r = table(s, d, "fetch_responses").where("source is not null").select("resp_id", "source", "http_status").distinct()
    bad = F.avg(F.coalesce(F.col("http_status") >= 400, F.lit(True)).cast("int"))
    return r.groupBy("source").agg(F.round(bad, 6).alias("failed"), (bad >= 0.2).alias("alert"))


@query("SELECT count(*) AS n, count(cluster_id) AS clustered, count(DISTINCT source) AS sources FROM news_items")
def count_items(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "news_items").agg(F.count("*").alias("n"), F.count("cluster_id").alias("clustered"), F.countDistinct("source").alias("sources"))


@query("""
SELECT item_id, CASE WHEN stars IS NULL OR c IS NULL THEN 0 ELSE round(stars / greatest((epoch_us(TIMESTAMPTZ '2026-03-10 00:00:00+00') - epoch_us(c)) / 86400e6, 1), 6) END AS velocity FROM (SELECT item_id, TRY_CAST(json_extract_string(facts, '$.github.stars') AS BIGINT) AS stars, TRY_CAST(json_extract_string(facts, '$.github.created_at') AS TIMESTAMPTZ) AS c FROM news_items) WHERE stars IS NOT NULL
""")
def stars_a_day(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "news_items").select("item_id", facts.number(F.col("facts"), "github", "stars").alias("stars"), F.expr("try_cast(get_json_object(facts, '$.github.created_at') as timestamp)").alias("c")).where("stars is not null")
    days = F.when(F.col("c").isNotNull(), F.greatest((F.unix_micros(_now()) - F.unix_micros("c")) / 86_400e6, F.lit(1.0)))
    return n.select("item_id", F.coalesce(F.round(F.col("stars") / days, 6), F.lit(0.0)).alias("velocity"))
