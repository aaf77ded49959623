"""Text functions as Column expressions: cleaning, words, names, labels."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

_WS = r"(?U)[\s\x1c-\x1f]+"
# Capitalised words that name nothing.
ENTITY_STOP = (
    "the a an and or of to in on for with by at from as is are be its it this that these those new says said say after over amid into out off "
    "you your need know how why what who when will can could may might not more most than then now just still amp ceo cfo ipo gdp monday tuesday "
    "wednesday thursday friday saturday sunday january february march april june july august september october november december"
).split()
# Words of repository names that tell no project.
NAME_STOP = (
    "agent agents agentic ai llm llms gpt app apps tool tools framework studio desktop mobile web api sdk cli lib kit awesome open chat bot bots "
    "model models code coding assistant the for and with your data deep self auto smart easy"
).split()
# Spellings under which an aggregator's mirrors appear.
MIRROR_MARKS = ("google-news", "googlenews", "google_news", "google news")
# Punctuation around a subject's words.
SUBJECT_EDGE = "「」『』\"'《》【】()()[]，,。.、!！?？:：;；—-_/\\|·　 "


@F.pandas_udf(StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def unescaped(text: Column) -> Column:
    """HTML entities replaced; only texts with an ampersand leave the JVM."""
    return F.when(F.contains(text, F.lit("&")), _unescape(F.when(F.contains(text, F.lit("&")), text))).otherwise(text)


def folded(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _WS, " "))


def clean_text(raw: Column) -> Column:
    """Text without tags, addresses, long base64 runs and entities, white space folded; null gives the empty text."""
    t = F.regexp_replace(F.coalesce(raw, F.lit("")), "<[^>]+>", " ")
    t = F.regexp_replace(t, r"https?://(?U)\S+", " ")
    t = F.regexp_replace(t, r"\b[A-Za-z0-9+/]{40,}={0,2}\b", " ")
    return folded(unescaped(t))


@F.pandas_udf(IntegerType())
def _beyond(body: pd.Series, title: pd.Series) -> pd.Series:
    known = title.map(lambda t: {w.lower() for w in re.findall(r"\w+", t) if len(w) > 1})
    return pd.Series([sum(len(w) for w in re.findall(r"\w+", b) if w.lower() not in k) for b, k in zip(body, known)], dtype="int32")


def body_beyond_title(content: Column, title: Column) -> Column:
    """Characters of the body's words that the title, in words of two characters or more, doesn't have.

    Unescaping already leaves the JVM, and its result can't enter a lambda, so the words are counted on the way.
    """
    return _beyond(clean_text(content), clean_text(title))


def source_family(source: Column) -> Column:
    s = F.lower(F.trim(F.coalesce(source, F.lit(""))))
    mirror = F.lit(False)
    for m in MIRROR_MARKS:
        mirror = mirror | F.contains(s, F.lit(m))
    return F.when(mirror, "google-news").otherwise(s)


def salient_entities(text: Column) -> Column:
    """Distinct capitalised Latin tokens of three characters or more, in small letters, without stop words."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z][A-Za-z0-9.&\-]{2,}"), F.lit(0))
    names = F.transform(F.filter(tokens, lambda t: F.rlike(t, F.lit("^[A-Z]"))), lambda t: F.regexp_replace(F.lower(t), r"^\.+|\.+$", ""))
    return F.array_distinct(F.filter(names, lambda t: (t != "") & ~t.isin(ENTITY_STOP)))


def normalize_subject(raw: Column) -> Column:
    edge = "[" + "".join("\\" + c if not c.isalnum() else c for c in SUBJECT_EDGE) + "]+"
    words = F.transform(F.split(folded(F.lower(F.coalesce(raw, F.lit("")))), " "), lambda t: F.regexp_replace(t, f"^{edge}|{edge}$", ""))
    return F.array_join(F.filter(words, lambda t: t != ""), " ")


def subject_tokens(raw: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normalize_subject(raw), " "), lambda t: t != ""))


def subject_closeness(a: Column, b: Column) -> Column:
    """1 where one's words hold the other's, else the share of common words; 0 where either has none."""
    x, y = subject_tokens(a), subject_tokens(b)
    both, all_ = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    empty = (F.size(x) == 0) | (F.size(y) == 0)
    return F.when(empty, 0.0).when((F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0), 1.0).otherwise(both / F.greatest(all_, F.lit(1)))


def repo_display(url: Column) -> Column:
    """owner/repo of a repository's address; null for other addresses."""
    name = F.regexp_extract(F.coalesce(url, F.lit("")), r"^.*?github\.com/+([^/]+/+[^/]+)", 1)
    return F.when(name != "", F.regexp_replace(name, "/+", "/"))


def repo_key(url: Column) -> Column:
    return F.lower(repo_display(url))


def name_tokens(repo: Column) -> Column:
    name = F.regexp_replace(F.lower(F.coalesce(repo, F.lit(""))), "^[^/]*/", "")
    return F.array_distinct(F.filter(F.split(name, "[^a-z0-9]+"), lambda t: (F.length(t) >= 3) & ~t.isin(NAME_STOP)))


def visible_length(markup: Column) -> Column:
    """Characters without tags and white space."""
    return F.length(F.regexp_replace(F.regexp_replace(F.coalesce(markup, F.lit("")), "<[^>]+>", ""), _WS, ""))


def comparable(text: Column) -> Column:
    """Small letters without addresses, white space and signs."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"https?://(?U)\S+", "")
    return F.regexp_replace(t, r"(?U)[\W_]+", "")


def lead(text: Column, most: int = 30) -> Column:
    """The first sentence; beyond ``most`` characters cut at the last clause mark in the second half, if any."""
    t = F.trim(F.coalesce(text, F.lit("")))
    first = F.trim(F.element_at(F.filter(F.split(t, r"[。！？!?\n；;]"), lambda p: F.trim(p) != ""), 1))
    head = F.substring(F.coalesce(first, t), 1, most)
    cut = F.regexp_extract(head, rf"^(?s)(.{{{most // 2},}})[，,、：:—].*$", 1)
    return F.when(F.length(F.coalesce(first, t)) <= most, F.coalesce(first, t)).when(cut != "", cut).otherwise(head)


def matches_any(text: Column, patterns: Column) -> Column:
    return F.exists(F.coalesce(patterns, F.array().cast("array<string>")), lambda p: F.rlike(F.coalesce(text, F.lit("")), p))


def label_from_slug(name: Column, slug: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), F.initcap(F.regexp_replace(slug, "[_-]+", " ")))
