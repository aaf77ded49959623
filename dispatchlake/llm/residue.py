"""Template residue, filler and error pages in place of content.

Records are aligned by template and slots are induced; no list of page texts is used.

* A field is cut into units (lines and sentences). A unit's template is what is left when numbers, names, variable
  names and blanks are taken for slots; units of other records with the same template show how the slots are filled.
  A slot that keeps a marked-up variable, or one that keeps a bare variable name, an empty value of a programming
  language or nothing where other records fill it, is unfilled.
* The notations of public template languages are known; others are induced: signs that wrap, mostly, the names that
  the known notations wrap, are a notation too. A marker in quotes, or one that keeps its surroundings over records
  of other stories beside a word for such things, is what a text talks about.
* A whole field that recurs, numbers and ids aside, as the content of unrelated records is a page template or a
  default, and so are its units wherever they make up a field. Units that stand only beside those belong to the page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from http import HTTPStatus

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dispatchlake.functions.tables import Scratch, table
from dispatchlake.llm.lookalike import skeleton

# How programming languages write an empty value.
LITERALS = ("undefined", "null", "nan", "none", "nil", "n/a", "(null)", "[object object]")
# Words of the customary Latin filler.
LATIN_FILLER = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua "
    "enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit "
    "voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt "
    "mollit anim id est laborum".split()
)
_TELLING = frozenset(w for w in LATIN_FILLER if len(w) > 3)
_ID = re.compile(r"(?=[0-9a-f-]*\d)[0-9a-f][0-9a-f-]{6,}(?![\w])", re.IGNORECASE)
#: What a text must hold for _ID to be in it; that is quicker to look for.
_HEX = re.compile(r"[0-9a-fA-F-]{7}")
_DIGITS = re.compile(r"\d\d*(?:[.,]\d+)*")  # begins with a set, which re looks for at once
_REPEATED = re.compile(r"([^\W\d_])\1{3,}\Z|(\W)\2*\Z|(\w{3,})(?:\W+\3)+\Z")
#: A masked request id with a word or two before it.
_REFERENCE = re.compile(r"\W*(?:[^\W\d_]+\W+){0,2}§\W*\Z")
_PHRASES = {f"{s.value}": s.phrase.casefold() for s in HTTPStatus if s.value >= 400}
_PHRASE = frozenset(_PHRASES.values())
_STATUS = re.compile(r"[45](?<!\w[45])\d\d\b")
_NAME = r"\s*[A-Za-z][\w.]*(?:\s*\|\s*\w+)?\s*"
#: Notations of public template languages, and prompts to put something in.
MARKER = re.compile(
    rf"\{{\{{[#/]?{_NAME}\}}\}}|\$\{{{_NAME}\}}|#\{{{_NAME}\}}|<%=?{_NAME}%>|\{{%-?\s*[A-Za-z][^%\n]{{0,60}}%\}}|%%{_NAME}%%|\[\[{_NAME}\]\]"
    r"|(?<![A-Za-z0-9_])__[A-Z][A-Z0-9_]*?__(?![a-z_])|__[A-Z][A-Z0-9_]*?__|\[(?:INSERT|ENTER|ADD|YOUR)\s[^\]\n]{1,40}\]|<[A-Za-z][\w. ]{1,40} here>|<!--[^>\n]{0,60}-->",
)
_SIGN = r"[@#$%^&~|<>{}\[\]\\/=!?+*:-]"
#: Any name between signs; which signs are a notation is induced.
_WRAPPED = re.compile(rf"(?<![\w@#$%^&~|<>{{}}\[\]\\=*])({_SIGN}{{2,4}}|[<{{\[$%@])\s?([A-Za-z][\w.]{{1,40}})\s?({_SIGN}{{1,4}})")
_OPENINGS = ("{", "<", "[", "__", "%%", "@", "$", "#", "~", "^", "|", "*", "&", "\\", "=")
_QUOTES = "`\"'“”„‘’«»‚「」『』"
_UNITS = re.compile(r"\s(?:(?<=[.!?…]\s)\s*|(?<=\n))")
_WORDS = re.compile(r"\w+")
_VARIABLE = r"(?<![\w.])[a-z]+(?:_[a-z]+)+(?![\w.])"
_GAP, _CODE = "\ue000", "\ue001"
_WIDE = re.compile(r"(?<=[^\W\d_]) {2,}(?=\w)")
#: What may hold a slot without filling it, and a gap that a slot has left.
_EMPTY = re.compile(rf"(?<![\w/])(?:undefined|null|nan|NaN|None|nil|N/A|\(null\)|\[object Object\])(?![\w/])|{_VARIABLE}|\(\s*\)|{_GAP}|\s+(?=[,;]\s)")
_SUSPECT = ("_", "(", "[object", "undefined", "null", "nan", "NaN", "None", "nil", "N/A", " ,", " ;", _GAP)
#: Units of a short field at most, and its characters: beyond that more evidence is asked for.
SHORT_UNITS, SHORT_CHARS = 8, 500
#: Words of a unit, at most, that may be two page texts in one.
CUT_WORDS = 16
#: Share of the units of a longer field that must be known or learned.
SHARE = 0.9
#: Words that tell that a text speaks about a marker.
_NOTATION = re.compile("variable|placeholder|template|syntax|notation|markup|platzhalter|vorlage|gabarit|plantilla|变量|占位符|模板|променлив|шаблон")
#: Records of other stories in which a marker with such words must keep its surroundings to be part of the text.
MENTIONS = 4
#: Unrelated records over which a short and a longer content must recur; a short one may stand in their titles as well.
RECURS, UNRELATED = 3, 6
#: Records with other values that must show a slot filled.
FILLED = 3


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf8", "surrogatepass")) - (1 << 63)


def _units(text: str) -> list[str]:
    """Lines, and sentences: to a stop and the blanks behind it, or to a wide stop."""
    for stop in "。！？":
        text = text.replace(stop, f"{stop}\n")
    return _UNITS.split(text)


def _strict(text: str) -> str:
    """As it is but for case, ids (already §) and HTTP's statuses, so that texts that differ in a fact differ."""
    return _STATUS.sub(_CODE, text).casefold()


def masked(strict: str) -> str:
    """With 9 for all other numbers."""
    return _DIGITS.sub("9", strict)


def _latin(unit: str) -> bool:
    w = _WORDS.findall(unit.casefold())
    return sum(x in LATIN_FILLER for x in w) >= max(min(2, len(w)), 0.8 * len(w)) and any(len(x) > 3 for x in w)


def _status(raw: str) -> bool:
    """Whether a unit is a phrase of HTTP's statuses, alone or with its own number and two other words at most."""
    low = raw.casefold()
    if not (m := _STATUS.search(raw)):
        return " " in low and low.strip(" .!") in _PHRASE
    phrase = _PHRASES.get(m[0], "")
    return bool(phrase) and phrase in low and len(_WORDS.findall(low.replace(phrase, "").replace(m[0], ""))) <= 2


def known(raw: str, unit: str) -> bool:
    """Whether a unit by itself is nothing but an empty value, one thing repeated, a request id or a status."""
    return unit.strip(" .!¡*#") in LITERALS or unit in LITERALS or len(unit) > 3 and bool(_REPEATED.match(unit)) or "§" in unit and bool(_REFERENCE.match(unit)) or _status(raw)


#: A title is looked at as such and for what its content stands beside.
_seen = lru_cache(maxsize=64)(skeleton)


def _holds(text: str, signs: tuple[str, ...]) -> bool:
    for x in signs:  # quicker than any()
        if x in text:
            return True
    return False


def _subject(title: str | None) -> int:
    """What a title is about, roughly: its first three words as they look."""
    return _hash(" ".join(_seen(title or "").casefold().split()[:3]))


def pattern(unit: str, empty: bool) -> int:
    """Hash of a unit's template: its small words, without names, numbers, variables and gaps; 0 if too little is left."""
    if empty:
        unit = _EMPTY.sub(" ", MARKER.sub(" ", unit))
    words = unit.split()
    kept = [w for w in words if w[0].islower()]
    if len(kept) == len(words) or not words:
        return 0
    if words[0] is not (kept[0] if kept else None) and len(words[0]) <= 4 and words[0].isalpha():
        kept.insert(0, words[0].lower())
    return _hash(" ".join(kept)) if len(kept) > 1 else 0


def _cuts(raw: str, unit: str) -> Iterator[tuple[int, int, bool, int, bool]]:
    """The ways to cut a unit of few words in two, the request id at its end put aside: page texts that follow each other without a stop."""
    words, said = unit.split(), raw.split()
    if not 1 < len(words) == len(said) <= CUT_WORDS:
        return
    whole, coded = _hash(unit), bool(_STATUS.search(raw))
    for end in [len(words), len(words) - 2, len(words) - 3] if "§" in words[-1] else [len(words)]:
        for i in range(1, end + (end < len(words))):
            a, b = " ".join(words[:i]), " ".join(words[i:end])
            alone = (lambda r, u, n: n == 1 and u in LITERALS or coded and _status(" ".join(r)))
            yield whole, _hash(a), alone(said[:i], a, i), _hash(b), not b or alone(said[i:end], b, end - i)


_ROWS = {
    "item_seq": pa.int64(), "field": pa.string(), "sure": pa.bool_(), "units": pa.list_(pa.int64()), "known": pa.list_(pa.bool_()), "patterns": pa.list_(pa.int64()), "empty": pa.list_(pa.bool_()),
    "whole": pa.int64(), "other": pa.int64(), "marks": pa.list_(pa.int64()), "kinds": pa.list_(pa.string()), "names": pa.list_(pa.string()), "quoted": pa.list_(pa.bool_()), "short": pa.bool_(),
    "cut_unit": pa.list_(pa.int64()), "cut_a": pa.list_(pa.int64()), "cut_a_known": pa.list_(pa.bool_()), "cut_b": pa.list_(pa.int64()), "cut_b_known": pa.list_(pa.bool_()),
}
_SCHEMA = ", ".join(f"{n} {t}".replace("list<item: ", "array<").replace("int64", "long").replace("bool", "boolean") for n, t in _ROWS.items())


def _fields(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per field what can be said of it alone, its units with their templates, and its markers."""
    for batch in batches:
        for at in range(0, len(batch), 1000):
            part = batch.slice(at, 1000)
            out: dict[str, list] = {n: [] for n in _ROWS}
            for seq, *texts in zip(*(part.column(i).to_pylist() for i in range(3))):
                others = (_hash(texts[1] or ""), _subject(texts[0]))
                for field, t, other in zip(("title", "content"), texts, others):
                    if t and (row := _field(field, t)):
                        for n, v in zip(_ROWS, (seq, field, *row[:5], row[5], other, *row[6:])):
                            out[n].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in _ROWS.items()], names=list(_ROWS))


def _field(field: str, t: str) -> tuple | None:
    shown = "\n".join(_seen(x) for x in (_WIDE.sub(f" {_GAP} ", t) if "  " in t else t).split("\n"))
    if not shown.strip():
        return None
    marks, wraps = [], []
    if _holds(shown, _OPENINGS):
        spans = []
        for m in MARKER.finditer(shown):
            spans.append(m.span())
            quoted = shown[: m.start()].rstrip(" ")[-1:] in _QUOTES and shown[m.end() :].lstrip(" ")[:1] in _QUOTES and m.start() > 0
            wraps.append(("", "_".join(_WORDS.findall(m[0])).strip("_").casefold(), True))
            if not quoted:
                before, after = (_WORDS.findall(MARKER.sub(" ", x)) for x in (shown[max(0, m.start() - 60) : m.start()], shown[m.end() : m.end() + 60]))
                marks.append(_hash(f"{before[-2:], after[:1]}{m[0]}") if _NOTATION.search(" ".join(before[-4:] + after[:2]).casefold()) else 0)
        for m in _WRAPPED.finditer(shown):
            if not any(a < m.end() and m.start() < z for a, z in spans):
                quoted = shown[: m.start()][-1:] in _QUOTES and shown[m.end() :][:1] in _QUOTES and m.start() > 0
                wraps.append((f"{m[1]} {m[3]}", m[2].replace(".", "_").casefold(), quoted))
    low = shown.casefold()
    filler = not _TELLING.isdisjoint(low.replace(".", " ").split()) and any(map(_latin, _units(low)))
    raws = _units(_ID.sub("§\n", shown) if _HEX.search(shown) else shown)
    strict = _strict("\0".join(raws))
    pairs = [(r, v) for r, u in zip(raws, masked(strict).split("\0")) if (v := u.strip())]
    hollow = bool(marks) or _holds(shown, _SUSPECT) and bool(_EMPTY.search(shown))
    short = len(shown) <= SHORT_CHARS and len(pairs) <= SHORT_UNITS
    cuts = [x for r, u in pairs if short and (field == "content" or "§" in u) for x in _cuts(r, u)]
    return (
        filler, [_hash(u) for _, u in pairs], [len(u) <= 80 and known(r, u) for r, u in pairs], [pattern(r, hollow) for r, _ in pairs], [hollow and bool(_EMPTY.search(r)) for r, _ in pairs],
        _hash(strict), marks, *(map(list, zip(*wraps)) if wraps else ([],) * 3), short, *(map(list, zip(*cuts)) if cuts else ([],) * 5),
    )


def _unfilled(rows: DataFrame) -> DataFrame:
    """(item_seq, field) with a slot that other records of the same template fill and this one doesn't."""
    asks = rows.where("exists(empty, x -> x)").select("item_seq", "field", F.inline(F.arrays_zip(F.col("patterns").alias("pattern"), F.col("empty").alias("is_empty")))).where("is_empty and pattern <> 0").select("item_seq", "field", "pattern").distinct()
    each = rows.select("other", F.inline(F.arrays_zip(F.col("patterns").alias("pattern"), F.col("empty").alias("is_empty"), F.col("units").alias("unit"))))
    held = each.where("not is_empty").join(asks.select("pattern").distinct(), "pattern", "left_semi")
    fills = held.groupBy("pattern").agg(F.approx_count_distinct("unit").alias("values"), F.approx_count_distinct("other").alias("others")).where(F.least("values", "others") >= FILLED)
    return asks.join(fills, "pattern", "left_semi").select("item_seq", "field")


def _markers(rows: DataFrame) -> DataFrame:
    """(item_seq, field) with a marked-up variable that the text doesn't talk about."""
    key = ["item_seq", "field"]
    marks = rows.where("size(marks) > 0").select(*key, "other", F.explode("marks").alias("mark"))
    said = marks.where("mark <> 0").select("mark", "other").distinct().groupBy("mark").count().where(F.col("count") >= MENTIONS).select("mark")
    wraps = rows.where("size(kinds) > 0").select(*key, F.inline(F.arrays_zip(F.col("kinds").alias("kind"), F.col("names").alias("name"), "quoted")))
    names = wraps.where("kind = ''").select("name").distinct().withColumn("is_name", F.lit(True))
    others = wraps.where("kind <> ''").join(names, "name", "left")
    induced = others.groupBy("kind").agg(F.avg(F.col("is_name").isNotNull().cast("int")).alias("share"), F.countDistinct(F.when(F.col("is_name"), F.col("name"))).alias("n"))
    more = others.where("not quoted").join(induced.where("share >= 0.5 and n >= 2").select("kind"), "kind", "left_semi").select(*key)
    return marks.join(said, "mark", "left_anti").select(*key).unionByName(more)


def residue(items: DataFrame) -> DataFrame:
    """(item_seq, field) of every title or content that is or holds template residue, filler or an error page.

    Null, empty and blank fields are no case; rows repeated under one item_seq count once. Other columns are ignored.
    What recurs is learned from the records given: a page text that stands in one record only, and is no status of
    HTTP, empty value or filler, can't be told from a short real text and is no case.
    """
    scratch = Scratch(items.sparkSession)
    cut = scratch.keep
    rows = cut(items.select("item_seq", "title", "content").mapInArrow(_fields, _SCHEMA))
    key = ["item_seq", "field"]
    # Whole contents that recur over unrelated records; pre-aggregated by what stands beside them.
    whole = rows.groupBy("whole", "short", "field", "other").agg(F.countDistinct("item_seq").alias("n"))
    content = F.col("field") == "content"
    recurs = whole.groupBy("whole", "short").agg(F.sum(F.when(content, F.col("n"))).alias("n"), F.count_if(content).alias("others"), F.count_if(~content).alias("titled"))
    enough = (F.col("others") >= F.when(F.col("short"), RECURS).otherwise(UNRELATED)) | F.col("short") & (F.col("others") > 0) & (F.col("others") + F.col("titled") >= RECURS)
    constant = recurs.where(enough & (F.col("others") >= 0.5 * F.col("n"))).select("whole")
    alone = cut(rows.where(content).join(constant, "whole", "left_semi").select(*key, "units"))
    seeds = alone.select(F.explode("units").alias("unit")).distinct()

    # Two page texts in one unit.
    cuts = rows.where("size(cut_unit) > 0").select(F.inline(F.arrays_zip(*(F.col(f"cut_{c}").alias(c) for c in ("unit", "a", "a_known", "b", "b_known")))))
    first = cuts.where("a_known").unionByName(cuts.where("not a_known").join(seeds.select(F.col("unit").alias("a")), "a", "left_semi")).select("unit", "b", "b_known").distinct()
    composed = first.where("b_known").unionByName(first.where("not b_known").join(seeds.select(F.col("unit").alias("b")), "b", "left_semi")).select("unit")
    seeds = cut(seeds.unionByName(composed).distinct())

    # Only fields that hold a known unit can hold its neighbours.
    of = lambda df: df.select(*key, "other", "short", F.inline(F.arrays_zip(F.col("units").alias("unit"), F.col("known").alias("rule"))))
    unit = of(rows)
    holds = unit.where("rule").select(*key).unionByName(unit.where("not rule").join(seeds, "unit", "left_semi").select(*key)).distinct()
    some = cut(of(rows.join(holds, key, "left_semi")).distinct().join(seeds.withColumn("seed", F.lit(True)), "unit", "left").select(*key, "other", "short", "unit", (F.col("rule") | F.col("seed").isNotNull()).alias("is_known")))
    beside = some.where("not is_known").groupBy("unit", "other").agg(F.count("*").alias("with"), F.count_if("short").alias("with_short"))
    beside = beside.groupBy("unit").agg(F.sum("with").alias("with"), F.sum("with_short").alias("with_short"), F.count("*").alias("others"))
    n = unit.join(beside.select("unit"), "unit", "left_semi").groupBy("unit").agg(F.countDistinct(*key).alias("n"), F.countDistinct(*(F.when(F.col("short"), F.col(c)) for c in key)).alias("n_short"))
    wide = F.expr(f"others >= {UNRELATED} and `with` >= 0.9 * n")
    grown = beside.join(n, "unit").where(F.expr("n_short >= 2 and with_short >= 0.9 * n_short") | wide).select("unit", wide.alias("wide"))
    told = F.col("is_known") | F.when(F.col("short"), F.col("wide").isNotNull()).otherwise(F.coalesce("wide", F.lit(False)))
    pages = (
        some.join(grown, "unit", "left").groupBy(*key, "short").agg(F.avg(told.cast("int")).alias("share"))
        .where(F.expr(f"share = 1 or not short and share >= {SHARE}")).select(*key)
    )
    return scratch.end(rows.where("sure").select(*key).union(_markers(rows)).union(_unfilled(rows)).union(pages).union(alone.select(*key)).distinct())


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p7_found of TESTDATA.md."""
    return residue(table(spark, sf_dir, "news_items"))
