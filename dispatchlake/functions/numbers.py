"""Reconciling the numbers of a text with facts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "[待核实]"
#: Digits that neither a word nor an opening brace precedes.
BARE = r"(?U)(?<![\w{])\d[\d,.]*%?"
TOKEN = r"\{\s*(F\d+)\s*\}"
# Strong claims by kind.
RISKY = {
    "上市/融资": r"(?i)IPO|(?:申请|提交|秘密|筹备|赴[美港]|挂牌)[^。,;\n]{0,6}上市|上市(?:申请|计划|传闻)|敲钟|估值",
    "倍数话术": r"翻[倍番]|倍增|[0-9零一两二三四五六七八九十百千几数]+\s*倍",
    "临床突破": r"治愈|根治|攻克|突破性疗法|临床突破",
    "战报/制裁": r"伤亡|阵亡|击毙|击落|击沉|歼灭|空袭|轰炸|封锁|制裁|宣战|停火",
    "地缘断言": r"和平(?:协议|方案|计划)?[^。,;\n]{0,6}(?:达成|敲定|签署|生效)|(?:全面|永久|正式)停火|(?:自由|免费|恢复|开放)[^。,;\n]{0,4}(?:通航|通行|航行)|(?:解除|取消|撤销)[^。,;\n]{0,4}(?:封锁|制裁)",
    "对比断言": r"反超|碾压|吊打|遥遥领先|霸榜|新(?:王|霸主|王者)|(?:超越|击败|打败|反杀)[^。,;\n]{0,8}(?:成为|登顶|夺冠|问鼎|称王)",
}


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def bare_numbers(text: Column) -> Column:
    return F.regexp_extract_all(_text(text), F.lit(BARE), F.lit(0))


def norm_number(n: Column) -> Column:
    """Without thousands commas and closing points; a percent sign stays."""
    return F.regexp_replace(F.replace(n, F.lit(",")), r"\.+$", "")


def unsourced_numbers(text: Column, source: Column) -> Column:
    """Distinct numbers of ``text``, in order, that ``source`` doesn't hold."""
    held = F.transform(bare_numbers(source), norm_number)
    return F.array_distinct(F.filter(bare_numbers(text), lambda n: ~F.array_contains(held, norm_number(n))))


def scrub_numbers(text: Column, source: Column) -> Column:
    """``text`` with its unsourced numbers replaced by the mark."""
    held = F.transform(bare_numbers(source), norm_number)
    gaps = F.split(_text(text), BARE, -1)
    put = F.transform(bare_numbers(text), lambda n: F.when(F.array_contains(held, norm_number(n)), n).otherwise(MARK))
    return F.array_join(F.flatten(F.zip_with(gaps, put, lambda g, n: F.array(_text(g), _text(n)))), "")


def tokens_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(_text(text), F.lit(TOKEN), F.lit(1)))


def render_tokens(text: Column, values: Column) -> Column:
    """Tokens replaced by the map's values, unknown ones by the mark."""
    gaps = F.split(_text(text), TOKEN, -1)
    put = F.transform(F.regexp_extract_all(_text(text), F.lit(TOKEN), F.lit(1)), lambda t: F.coalesce(F.element_at(values, t), F.lit(MARK)))
    return F.array_join(F.flatten(F.zip_with(gaps, put, lambda g, v: F.array(_text(g), _text(v)))), "")


def scrub_markup(text: Column) -> Column:
    """Broken tokens marked, braces taken off."""
    t = F.regexp_replace(_text(text), r"F\d+S\d+", MARK)
    return F.translate(F.regexp_replace(t, r"\{([^{}]*)\}", "$1"), "{}", "")


def risky_claims(text: Column) -> Column:
    """Distinct kind:match of every strong claim, kinds in their order."""
    def named(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(_text(text), F.lit(pattern), F.lit(0)), lambda m: F.concat(F.lit(kind + ":"), m))

    each = [named(*x) for x in RISKY.items()]
    return F.array_distinct(F.flatten(F.array(*each)))


def verified(text: Column, values: Column, source: Column, corroboration: Column, least_sources: int) -> Column:
    """struct(rendered, status, unresolved, suspects, risky) of a text with tokens."""
    shown = scrub_markup(render_tokens(text, values))
    unresolved = F.filter(tokens_of(text), lambda t: F.element_at(values, t).isNull())
    suspects = unsourced_numbers(F.regexp_replace(_text(text), TOKEN, " "), source)
    risky = F.when(corroboration < least_sources, risky_claims(shown)).otherwise(F.array().cast("array<string>"))
    bad = (F.size(unresolved) > 0) | (F.size(suspects) > 0) | (F.size(risky) > 0)
    return F.struct(shown.alias("rendered"), F.when(bad, "needs_review").otherwise("ok").alias("status"), unresolved.alias("unresolved"), suspects.alias("suspects"), risky.alias("risky"))
