"""One form for texts that look alike.

The words of all titles form a vocabulary, parted by what they look like. In each part the clean spellings (one script,
nothing invisible) make a trie; every spelling walks it as an edit automaton in which a look-alike and an ignorable
character cost nothing and all else too much, and takes the commonest clean spelling it reaches. Spellings that reach
none are normalised by table.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dispatchlake.functions.tables import cut, table

# Letters of other scripts that look like a Latin letter.
LATIN_TWINS = {
    "cyrillic": "АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ЅS ІI ЈJ аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw ӏl ҮY ԌG",
    "greek": "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo ϲc ϳj ϹC",
    "armenian": "օo ոn հh սu Տ" "S",
    "latin": "ɑa ɡg",
}
TWIN = {pair[0]: pair[1] for pairs in LATIN_TWINS.values() for pair in pairs.split()}
CYRILLIC = {pair[1]: pair[0] for pair in reversed(LATIN_TWINS["cyrillic"].split())}
# Single signs that look like another.
SIGNS = {"\u2010": "-", "\u2011": "-", "\u02bc": "'", "\u2024": "."}
# Invisible characters besides the format characters (Unicode category Cf).
INVISIBLE = "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0"
#: Words in one part of the vocabulary, about.
PART = 50_000


@lru_cache(maxsize=None)
def _plain(c: str) -> str:
    """What a character stands for: nothing, a space, its plain form or itself, without regard to script."""
    if unicodedata.category(c) == "Cf" or c in INVISIBLE or "\ufe00" <= c <= "\ufe0f" or "\U000e0100" <= c <= "\U000e01ef":
        return ""
    if c.isspace() or c == "\u2800":
        return " "
    if "！" <= c <= "～" or "ﬀ" <= c <= "ﬆ" or "￠" <= c <= "￦":
        return unicodedata.normalize("NFKC", c)
    return SIGNS.get(c, c)


class _Table(dict):
    def __init__(self, rule):
        super().__init__()
        self.rule = rule

    def __missing__(self, code: int) -> str:
        self[code] = s = self.rule(chr(code))
        return s


_PLAIN = _Table(_plain)
_LOOK = _Table(lambda c: "".join(TWIN.get(x, x) for x in _plain(c)))


def _decomposed(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFD", text)


class _Calm(dict):
    """Whether a character, wherever it stands, is its own look."""

    def __missing__(self, c: str) -> bool:
        self[c] = calm = not unicodedata.combining(c) and unicodedata.normalize("NFC", unicodedata.normalize("NFD", c).translate(_LOOK)) == c or c.isspace()
        return calm


_CALM = _Calm()


def skeleton(text: str) -> str:
    """Equal for texts that look the same: Latin for look-alike letters, runs of any space as one, accents composed."""
    if text.isascii() or all(map(_CALM.__getitem__, set(text))):
        return " ".join(text.split())
    return " ".join(unicodedata.normalize("NFC", _decomposed(text).translate(_LOOK)).split())


def by_table(word: str) -> str:
    """A word in one script: Cyrillic where a letter in it is Cyrillic only, else Latin."""
    plain = _decomposed(word).translate(_PLAIN)
    cyrillic = any("Ѐ" <= c <= "ԯ" and c not in TWIN for c in plain)
    table_ = CYRILLIC if cyrillic else TWIN
    return unicodedata.normalize("NFC", "".join(table_.get(c, c) for c in plain))


def undecided(word: str) -> bool:
    """Whether the word's letters all stand in either script, so that only the vocabulary can tell."""
    letters = [c for c in unicodedata.normalize("NFD", word) if c.isalpha()]
    return bool(letters) and all(c in TWIN or c in CYRILLIC for c in letters)


def _scripts(word: str) -> int:
    return len({unicodedata.name(c, "?").split()[0] for c in word if c.isalpha()})


def clean(word: str) -> bool:
    return unicodedata.normalize("NFC", _decomposed(word).translate(_PLAIN)) == word and _scripts(word) <= 1


class Trie:
    """Clean spellings; ``closest`` walks all branches that a spelling can follow at no cost."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, count: int) -> None:
        node = self.root
        for c in unicodedata.normalize("NFD", word):
            node = node.setdefault(c, {})
        node[""] = node.get("", 0) + count

    def closest(self, word: str) -> str | None:
        """The commonest clean spelling within cost 0, by code points where equally common; None if there is none."""
        states = [(self.root, "")]
        for c in _decomposed(word):
            for target in _plain(c):
                look = TWIN.get(target, target)
                step = []
                for node, path in states:
                    for edge in {look, target, *_SAME_LOOK.get(look, ())}:
                        if edge in node:
                            step.append((node[edge], path + edge))
                states = step
        ends = [(-node[""], path) for node, path in states if "" in node]
        return unicodedata.normalize("NFC", min(ends)[1]) if ends else None


_SAME_LOOK: dict[str, list[str]] = {}
for _a, _b in TWIN.items():
    _SAME_LOOK.setdefault(_b, []).append(_a)


def words_of(title: str) -> list[str]:
    return _decomposed(title).translate(_Table_spaces).split(" ") if title else []


_Table_spaces = _Table(lambda c: " " if _plain(c) == " " else c)


def _key(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf8", "surrogatepass")) - (1 << 63)


def _vocabulary(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        n: Counter[str] = Counter()
        for t in f["title"]:
            if t:
                n.update(w for w in words_of(t) if w)
        yield pd.DataFrame({"look": [_key(skeleton(w)) for w in n], "word": list(n), "n": list(n.values())})


def _settle(f: pd.DataFrame) -> pd.DataFrame:
    trie = Trie()
    for w, n in zip(f["word"], f["n"]):
        w = unicodedata.normalize("NFC", w)
        if clean(w):
            trie.add(w, n)
    out = [(w, to) for w in f["word"] if (to := trie.closest(w) or by_table(w)) != by_table(w)]
    return pd.DataFrame(out, columns=["word", "spelling"])


def canonical_titles(titles: DataFrame) -> DataFrame:
    """(field, id, title, form) of every row of ``titles`` (field, id, title; other columns are ignored).

    Rows whose titles look alike have equal forms, others different ones. A null title has a null form, an empty or
    invisible one the empty form. Repeated rows stay. Titles of any length are treated whole.
    """
    titles = titles.select("field", F.col("id").cast("long").alias("id"), "title")
    words = titles.mapInPandas(_vocabulary, "look long, word string, n long").groupBy("look", "word").agg(F.sum("n").alias("n"))
    words = cut(words)
    parts = max(1, words.count() // PART)
    exceptions = words.groupBy(F.pmod("look", F.lit(parts)).alias("part")).applyInPandas(lambda f: _settle(f), "word string, spelling string")
    exceptions = cut(exceptions)

    def tabled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            forms, asks = [], []
            for t in f["title"]:
                w = [x for x in words_of(t) if x] if t is not None else []
                put = [by_table(x) for x in w]
                forms.append([x for x in put if x] if t is not None else None)
                asks.append([(n, x) for n, (x, p) in enumerate(zip([x for x, p in zip(w, put) if p], [p for p in put if p])) if undecided(p)])
            yield pd.DataFrame({"field": f["field"], "id": f["id"], "title": f["title"], "words": forms, "asks": [[{"at": n, "word": x} for n, x in a] for a in asks]})

    made = titles.mapInPandas(tabled, "field string, id long, title string, words array<string>, asks array<struct<at:int,word:string>>")
    asked = made.where("size(asks) > 0").select("field", "title", F.explode("asks").alias("a")).select("field", "title", "a.at", "a.word").distinct()
    told = asked.join(exceptions, "word").groupBy("field", "title").agg(F.map_from_entries(F.collect_list(F.struct("at", "spelling"))).alias("told"))
    fixed = F.transform("words", lambda w, n: F.coalesce(F.element_at("told", n), w))
    return made.join(told, ["field", "title"], "left").select(
        "field", "id", "title", F.when(F.col("title").isNotNull(), F.array_join(F.when(F.col("told").isNull(), F.col("words")).otherwise(fixed), " ")).alias("form")
    )


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "news_items").select(F.lit("title").alias("field"), F.col("item_seq").alias("id"), "title")
    return a.unionByName(table(spark, sf_dir, "summaries").select(F.lit("headline").alias("field"), "id", F.col("headline").alias("title")))


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p6_forms: the canonical form of every title and headline."""
    return canonical_titles(_titles(spark, sf_dir)).select("field", "id", "form")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p6_found of TESTDATA.md. All pairs are asked for there; empty forms pair with each other only if both are given."""
    made = cut(canonical_titles(_titles(spark, sf_dir)).where("form is not null").distinct())
    groups = made.groupBy("field", "form").agg(F.min("title").alias("a"), F.max("title").alias("b")).where("a <> b").select("field", "form")
    rows = made.join(groups, ["field", "form"])
    left = rows.select("field", "form", F.col("id").alias("lo_id"), F.col("title").alias("lo"))
    right = rows.select("field", "form", F.col("id").alias("hi_id"), F.col("title").alias("hi"))
    return left.join(right, ["field", "form"]).where("lo_id < hi_id and lo <> hi").select("field", "lo_id", "hi_id").distinct()
