"""Deliveries, running stories as tables, and the board of code projects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dispatchlake.functions import text

SENT = "sent"


def not_delivered(rows: DataFrame, ledger: DataFrame, key: list[str]) -> DataFrame:
    """Rows without a delivery of status sent under their key; skipped and failed ones may be tried again."""
    return rows.join(ledger.where(F.col("status") == SENT).select(*key).distinct(), key, "left_anti")


def record_deliveries(ledger: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The ledger with each new key that it lacks, once; what stands there stays."""
    first = new.select(*ledger.columns).dropDuplicates(key)
    return ledger.unionByName(first.join(ledger.select(*key), key, "left_anti"))


def deliver(rows: DataFrame, ledger: DataFrame, key: list[str], senders: dict[str, Callable[[dict], str]], channel: str = "channel") -> list[dict]:
    """Sends the undelivered rows, a few cards a run, by their channel's sender; what fails or has none is recorded, never raised."""
    out = []
    for r in not_delivered(rows, ledger, key).toLocalIterator():
        try:
            status = senders[r[channel]](r.asDict()) if r[channel] in senders else "skipped"
        except Exception:
            status = "failed"
        out.append({k: r[k] for k in key} | {"status": status})
    return out


def touched_stories(stories: DataFrame, links: DataFrame) -> DataFrame:
    """Stories after new links (story_id, headline, seen_at): heat grows by one each, the last one names them, and they are active again.

    Links to unknown stories open them. A story with no link stays as it is.
    """
    new = links.groupBy("story_id").agg(F.count("*").alias("n"), F.max("seen_at").alias("seen"), F.max_by("headline", F.struct("seen_at", "headline")).alias("newest"), F.min("seen_at").alias("first"))
    j = stories.join(new, "story_id", "full")
    return j.select(
        "story_id", F.coalesce("newest", "name").alias("name"), (F.coalesce("heat", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("heat"),
        F.coalesce("first_seen_at", "first").alias("first_seen_at"), F.greatest("last_seen_at", "seen").alias("last_seen_at"), F.when(F.col("n").isNotNull(), "active").otherwise(F.col("status")).alias("status"),
    )


def tracked(links: DataFrame, stories: DataFrame) -> DataFrame:
    """(cluster_id, story_id) of clusters that hang on an active story."""
    return links.join(stories.where("status = 'active'").select("story_id"), "story_id").select("cluster_id", "story_id").distinct()


def project_pool(items: DataFrame, active: DataFrame, since: Column, most: int = 200) -> DataFrame:
    """Projects with stars, dated since ``since``, from active sources for AI, LLMs or agents: the ``most`` with most stars."""
    stars = F.expr("try_cast(get_json_object(facts, '$.github.stars') as bigint)")
    rows = items.select("item_id", "url", "source", "published_at", stars.alias("stars"), F.get_json_object("facts", "$.github.created_at").alias("created_at"))
    rows = rows.where(F.col("stars").isNotNull() & (F.col("published_at") >= since) & F.lower("source").rlike("ai|llm|agent")).join(active.select("source").distinct(), "source", "left_semi")
    return rows.orderBy(F.desc("stars"), "item_id").limit(most)


def project_board(pool: DataFrame, elsewhere: DataFrame, words: DataFrame, snapshots: DataFrame, now: Column, excluded: tuple[str, ...] = (), limit: int = 10) -> DataFrame:
    """(project, item_id, stars, velocity, place): projects by stars a day, no two of one name, none that another board has.

    ``pool``: item_id, url, stars, created_at (bounded); ``elsewhere``: project keys of other boards; ``words``: words of
    other boards' cards. A project whose whole name and, where telling, owner stand among the words is left out.
    ``snapshots``: item_id, stars, observed_at; without an earlier one the speed is stars over age.
    """
    rows = pool.withColumn("project", text.repo_key(F.col("url"))).where(F.col("project").isNotNull() & ~F.coalesce(F.col("project").isin(*excluded) if excluded else F.lit(False), F.lit(False)))
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy("project").orderBy(F.desc("stars"), "item_id"))).where("rn = 1").drop("rn")
    rows = rows.join(elsewhere.select("project").distinct(), "project", "left_anti")
    rows = rows.withColumn("tokens", text.name_tokens(F.col("project"))).withColumn("owner", text.name_tokens(F.substring_index("project", "/", 1)))
    asked = rows.select("project", F.explode(F.array_distinct(F.concat("tokens", "owner"))).alias("word")).join(words.select("word").distinct(), "word", "left_semi")
    said = asked.groupBy("project").agg(F.collect_set("word").alias("said"))
    rows = rows.join(said, "project", "left").withColumn("said", F.coalesce("said", F.array().cast("array<string>")))
    same = (F.size("tokens") > 0) & (F.size(F.array_except("tokens", "said")) == 0) & ((F.size("owner") == 0) | F.arrays_overlap("owner", "said"))
    last = snapshots.where("stars is not null").groupBy("item_id").agg(F.max_by(F.struct(F.col("stars").alias("prev"), "observed_at"), F.struct("observed_at", "stars")).alias("s"))
    days = lambda t: F.when(t.isNotNull(), F.greatest((F.unix_micros(now) - F.unix_micros(t)) / 86_400e6, F.lit(1.0)))
    created = F.expr("try_cast(created_at as timestamp)")
    speed = F.coalesce((F.col("stars") - F.col("s.prev")) / days(F.col("s.observed_at").cast("timestamp")), F.col("stars") / days(created), F.lit(0.0))
    ranked = rows.where(~same).join(last, "item_id", "left").withColumn("velocity", speed)
    entry = F.struct((-F.col("velocity")).alias("v"), (-F.col("stars")).alias("s"), F.col("project").alias("p"), "item_id", "tokens")
    kept = F.aggregate(
        F.array_sort(F.collect_list(entry)), F.array().cast("array<struct<v:double,s:bigint,p:string,item_id:string,tokens:array<string>>>"),
        lambda k, e: F.when((F.size(k) < limit) & ~F.arrays_overlap(F.flatten(F.transform(k, lambda z: z["tokens"])), e["tokens"]), F.array_append(k, e)).otherwise(k),
    )
    out = ranked.agg(kept.alias("k")).select(F.posexplode("k").alias("pos", "e"))
    return out.select(F.col("e.p").alias("project"), "e.item_id", (-F.col("e.s")).alias("stars"), F.round(-F.col("e.v"), 6).alias("velocity"), (F.col("pos") + 1).alias("place"))
