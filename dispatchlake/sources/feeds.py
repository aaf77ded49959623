"""Bodies of feeds and APIs to raw items: url, title, content, published, facts.

Every parser takes rows of (source, body, ...) and gives one row for each entry, and rows with ``error`` for bodies that
can't be read, so that one broken source doesn't stop the others.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispatchlake.functions.text import visible_length

ITEM = "source string, position int, url string, title string, content string, published string, facts string, error string"
_URL = re.compile(r"https?://\S+\Z", re.IGNORECASE)


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1].lower()


def _entry(e: ET.Element) -> dict[str, list[ET.Element]]:
    out: dict[str, list[ET.Element]] = {}
    for c in e:
        out.setdefault(_local(c.tag), []).append(c)
    return out


def _text(e: ET.Element) -> str:
    return "".join(e.itertext()).strip()


def parse_feed(body: str | None) -> list[tuple] | str:
    """(url, title, content, published) of each entry with an address and a title, or what is wrong with the body."""
    if not body or not body.strip():
        return "empty body"
    start = body.lstrip()[:200].lower()
    try:
        root = ET.fromstring(body.strip())
    except ET.ParseError as e:
        return "an HTML page, not a feed" if "<html" in start or "<!doctype html" in start else f"not well-formed: {e}"
    if _local(root.tag) == "html":
        return "an HTML page, not a feed"
    out = []
    for e in root.iter():
        if _local(e.tag) not in ("item", "entry"):
            continue
        got = _entry(e)
        first = lambda *names: next((t for n in names for x in got.get(n, ()) if (t := _text(x))), "")  # noqa: B023, E731
        links = [x.get("href") or _text(x) for x in got.get("link", ()) if x.get("rel", "alternate") == "alternate"]
        guid = first("guid", "id")
        enclosure = next((x.get("url") or x.get("href") for x in got.get("enclosure", ())), "")
        url = next((x for x in links if x), "") or (guid if _URL.match(guid) else "") or enclosure or ""
        bodies = [_text(x) for n in ("summary", "description", "encoded", "content") for x in got.get(n, ())]
        content = max(bodies, key=lambda b: len(re.sub(r"<[^>]+>|\s", "", b)), default="")
        if url and first("title"):
            out.append((url, first("title"), content, first("pubdate", "published", "date", "updated") or None))
    return out


def rss(bodies: DataFrame) -> DataFrame:
    """Entries of RSS and Atom bodies (source, body); the longest visible text of an entry is its content, the first of equals."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for source, body in zip(f["source"], f["body"]):
                got = parse_feed(body)
                if isinstance(got, str):
                    rows.append((source, None, None, None, None, None, None, got))
                else:
                    rows += [(source, n, *x, None, None) for n, x in enumerate(got)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ITEM.split(", ")]).astype({"position": "Int32"})

    return bodies.select("source", "body").mapInPandas(run, ITEM)


def _items(bodies: DataFrame, schema: str, path: str | None, row: Callable[[Column], dict[str, Column]], keep: Callable[[Column], Column]) -> DataFrame:
    parsed = bodies.select("source", F.from_json("body", schema, {"mode": "PERMISSIVE"}).alias("j"))
    hits = F.col(f"j.{path}") if path else F.col("j")
    broken = parsed.where(hits.isNull()).select("source", F.lit("no list of entries").alias("error"))
    each = parsed.where(hits.isNotNull()).select("source", F.posexplode(hits).alias("position", "h")).where(keep(F.col("h")))
    made = row(F.col("h"))
    good = each.select("source", "position", *[made.get(c, F.lit(None).cast("string")).cast("string").alias(c) for c in ("url", "title", "content", "published", "facts")], F.lit(None).cast("string").alias("error"))
    return good.unionByName(broken, allowMissingColumns=True)


def _given(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def hackernews(bodies: DataFrame) -> DataFrame:
    schema = "hits array<struct<objectID:string,title:string,story_title:string,url:string,story_url:string,story_text:string,created_at:string,points:bigint,num_comments:bigint>>"
    talk = lambda h: F.concat(F.lit("https://news.ycombinator.com/item?id="), h["objectID"])
    row = lambda h: {
        "url": F.coalesce(_given(h["url"]), _given(h["story_url"]), talk(h)), "title": F.coalesce(_given(h["title"]), _given(h["story_title"])), "content": h["story_text"], "published": h["created_at"],
        "facts": F.to_json(F.struct(F.struct(h["points"].alias("points"), h["num_comments"].alias("num_comments")).alias("hn"))),
    }
    return _items(bodies, schema, "hits", row, lambda h: F.coalesce(_given(h["title"]), _given(h["story_title"])).isNotNull())


def github(bodies: DataFrame) -> DataFrame:
    schema = "items array<struct<full_name:string,html_url:string,description:string,pushed_at:string,created_at:string,stargazers_count:bigint,forks_count:bigint>>"
    row = lambda h: {
        "url": h["html_url"], "title": h["full_name"], "content": h["description"], "published": F.coalesce(_given(h["pushed_at"]), h["created_at"]),
        "facts": F.to_json(F.struct(F.struct(h["stargazers_count"].alias("stars"), h["forks_count"].alias("forks"), h["created_at"].alias("created_at")).alias("github"))),
    }
    return _items(bodies, schema, "items", row, lambda h: _given(h["html_url"]).isNotNull() & _given(h["full_name"]).isNotNull())


def papers(bodies: DataFrame) -> DataFrame:
    """A body is a list of papers; those without a date of their own are dropped."""
    schema = "array<struct<title:string,summary:string,publishedAt:string,paper:struct<id:string,title:string,summary:string,publishedAt:string,upvotes:bigint>>>"
    row = lambda h: {
        "url": F.concat(F.lit("https://huggingface.co/papers/"), h["paper.id"]), "title": F.coalesce(_given(h["paper.title"]), h["title"]), "content": F.coalesce(_given(h["paper.summary"]), h["summary"]),
        "published": F.coalesce(_given(h["paper.publishedAt"]), h["publishedAt"]), "facts": F.to_json(F.struct(F.struct(h["paper.upvotes"].alias("upvotes")).alias("hf"))),
    }
    return _items(bodies, schema, None, row, lambda h: _given(h["paper.id"]).isNotNull() & F.coalesce(_given(h["paper.publishedAt"]), _given(h["publishedAt"])).isNotNull())


def trending_repos(bodies: DataFrame, keywords: list[str], most: int = 30) -> DataFrame:
    """owner/repo rows whose name or description has one of the keywords as a word; the first ``most`` of each source."""
    schema = "data struct<rows:array<struct<repo_name:string,description:string,stars:string>>>"
    row = lambda h: {"url": F.concat(F.lit("https://github.com/"), h["repo_name"]), "title": h["repo_name"], "content": h["description"], "facts": F.to_json(F.struct(F.struct(h["stars"].cast("bigint").alias("stars")).alias("github")))}
    words = "(?i)(?<![A-Za-z0-9])(?:%s)(?![A-Za-z0-9])" % "|".join(map(re.escape, keywords))
    rows = _items(bodies, schema, "data.rows", row, lambda h: F.rlike(h["repo_name"], F.lit("^[^/]+/[^/]+$")) & F.rlike(F.concat_ws(" ", h["repo_name"], h["description"]), F.lit(words)))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("source").orderBy("position"))
    return rows.where("error is null").withColumn("rn_", place).where(F.col("rn_") <= most).drop("rn_").unionByName(rows.where("error is not null"))


#: Parsers by type of source; a type that isn't here is an error of the registry.
PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "rss": rss, "hackernews": hackernews, "github": github, "hf_papers": papers,
    "ossinsight": lambda b: trending_repos(b, ["ai", "llm", "gpt", "agent", "agents", "rag", "mcp", "machine learning", "deep learning"]),
}


def parser(kind: str) -> Callable[[DataFrame], DataFrame]:
    if kind not in PARSERS:
        raise NotImplementedError(f"no parser for sources of type {kind}")
    return PARSERS[kind]


def rolling_window(url: Column, now: Column) -> Column:
    """{created_since:Nd} in an address replaced by the date N days before ``now``."""
    days = F.regexp_extract(url, r"\{created_since:(\d+)d\}", 1)
    return F.when(days != "", F.regexp_replace(url, r"\{created_since:\d+d\}", F.date_format(F.date_sub(now, F.try_to_number(days, F.lit("99999")).cast("int")), "yyyy-MM-dd"))).otherwise(url)


def archive_days(bodies: DataFrame, last: int) -> DataFrame:
    """Records of the newest ``last`` readable days: (date, domain, position, headline, tldr, source, url). A body that isn't a day is skipped."""
    schema = "date string, domains array<struct<key:string,label:string,items:array<struct<headline:string,tldr:string,source:string,url:string>>>>"
    days = bodies.select(F.from_json("body", schema).alias("d")).where("d.date rlike '^[0-9]{4}-[0-9]{2}-[0-9]{2}$' and d.domains is not null")
    newest = days.select("d.date").distinct().orderBy(F.desc("date")).limit(last)
    low = F.lower(F.concat_ws(" ", "x.key", "x.label"))
    domain = F.when(F.rlike(low, F.lit("github|开源")), None).when(F.rlike(low, F.lit("bio|生物|医")), "bio").when(F.rlike(low, F.lit("geo|地缘|国际")), "geo").when(F.rlike(low, F.lit("ai|人工智能")), "ai")
    each = days.join(newest.withColumnRenamed("date", "newest_"), F.col("d.date") == F.col("newest_"), "left_semi").select("d.date", F.explode("d.domains").alias("x"))
    rows = each.withColumn("domain", domain).where("domain is not null").select("date", "domain", F.posexplode("x.items").alias("position", "i"))
    return rows.select("date", "domain", "position", "i.headline", "i.tldr", "i.source", "i.url")


def cases(lines: DataFrame, schema: str) -> DataFrame:
    """JSON lines with comments: blank lines and those beginning with # are skipped."""
    return lines.where("trim(value) <> '' and not trim(value) like '#%'").select(F.from_json("value", schema).alias("c")).where("c is not null").select("c.*")


def stored_items(items: DataFrame, sources: DataFrame, fetched_at: Column, parse_time: Callable[[Column], Column]) -> DataFrame:
    """Entries ready to be stored: excluded ones out first, then each source's head; untrusted and unread dates null.

    ``sources``: id, trust_published_at, max_items, url_exclude, title_exclude (arrays of patterns, may be null).
    """
    from pyspark.sql import Window

    from dispatchlake.functions.text import matches_any

    rows = items.where("error is null").join(sources.withColumnRenamed("id", "source"), "source")
    rows = rows.where(~matches_any(F.col("url"), F.col("url_exclude")) & ~matches_any(F.col("title"), F.col("title_exclude")))
    place = F.row_number().over(Window.partitionBy("source").orderBy("position", "url"))
    rows = rows.withColumn("rn_", place).where(F.col("rn_") <= F.coalesce("max_items", F.lit(2**31 - 1)))
    at = F.when(F.coalesce("trust_published_at", F.lit(True)), F.when(_given(F.col("published")).isNull(), fetched_at).otherwise(parse_time(F.col("published"))))
    return rows.select("source", "position", "url", "title", "content", "facts", at.alias("published_at"), fetched_at.alias("fetched_at"), visible_length(F.col("content")).alias("n_visible"))
