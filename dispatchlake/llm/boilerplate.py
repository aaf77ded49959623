"""Main text of a page apart from menus, notices, teasers and footers.

The lines of a page make a tree: runs of lines of one shape are blocks, and a run of headlines hangs on the short line
over it. Each node is article or not; sum-product messages go up and down the tree and give the marginal of every line.
The potentials are trained on labelled pages: the weights of a line's words, shape and place, and the tables between
parent and child. The labels come from the corpus: what recurs on pages about different matters, the page's own name
and numbers put aside, is not the article, unless it always parts two paragraphs.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import mul

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dispatchlake.functions.tables import cut, table
from dispatchlake.llm import residue
from dispatchlake.llm.hashing import mix
from dispatchlake.llm.lookalike import skeleton

#: Pages that the potentials are trained on, at most.
TRAIN_PAGES = 3_000
#: A line must stand on pages of so many different matters to be labelled as no part of the article.
MATTERS = 4
SPACE_BITS = 13
#: Exponent of the tables between block and line: the words already tell what the neighbours would repeat.
TEMPER = 0.6
PARAGRAPH, HEADLINE, LABEL = 0, 1, 2
_DIGITS = re.compile(r"\d[\d.,:]*")
_END = re.compile(r"[.!?。！？…:;][\"'”“»«’」』)\]]*$|[”“»«」』]$")
_BULLET = re.compile(r"^\s*(?:[•▪‣·*–—›»>-]|\d{1,2}[.)])\s+")
_SEPARATOR = re.compile(r"\s[|·/»>•–-]\s|  |[|]")
_WORD = re.compile(r"[^\W\d_]+|[§9©]")
_CJK = re.compile("[㐀-鿿]")
_COLON = re.compile(r"[^:：]{3,40}[:：]")
#: A line that a break in a sentence left: it ends after an initial, or holds one word and a full stop.
_INITIAL = re.compile(r"(?:^|\s)[^\W\d_]\.$|^[^\W\d_]+\.$")
SCHEMA = "item_seq long, field string, line int, shape int, logit float, whole long, start long, dense array<float>, words array<long>"
DENSE = 16
STATS = 6
#: Of a line: how often it stands, on pages of how many matters, how often between paragraphs, and how many matters so many pages have.
COUNTS = ("n", "matters", "mid", "many")


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf8", "surrogatepass")) - (1 << 63)


def _site(source: str | None, host: str | None) -> re.Pattern | None:
    """The names by which a page may call its own site."""
    names = set()
    if source:
        names |= {source.replace("_", " "), source.rsplit("_", 1)[0].replace("_", " ")}
    if host:
        parts = [p for p in host.split(".") if p != "www"]
        names |= {parts[0]} if parts else set()
    names = sorted((n for n in names if len(n) > 3), key=len, reverse=True)
    return re.compile("|".join(map(re.escape, names)), re.IGNORECASE) if names else None


def _matter(title: str | None) -> int:
    """Mostly equal for versions of one title, different for others: the least hash of its words."""
    text = skeleton(title or "").casefold()
    words = _WORD.findall(text)
    if _CJK.search(text):
        words = [text[i : i + 3] for i in range(max(1, len(text) - 2))]
    return min((_hash(w) for w in words if len(w) > 2), default=0)


def _separators(line: str) -> float:
    """Separators, in a long line for every 400 characters."""
    return len(_SEPARATOR.findall(line)) / max(1.0, len(line) / 400)


def shape_of(line: str) -> int:
    """Shape by size (a Chinese character counts three), end and separators."""
    end = line[-48:]
    if end[-1:] == "." and _INITIAL.search(end):
        return PARAGRAPH
    size = len(line) if len(line) >= 40 or line.isascii() else len(line) + 2 * len(_CJK.findall(line))
    if size < 40 or _separators(line) > 1:
        return LABEL
    return PARAGRAPH if _END.search(end[-8:]) else HEADLINE


class _Codes(dict):
    """Hashes of words, those met lately."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = code = xxhash.xxh32_intdigest(word.encode("utf8", "surrogatepass"))
        return code


_CODES = _Codes()


def _words(masked: str) -> list[int]:
    """Hashes of all words of a line, of Chinese of every two characters."""
    words = _WORD.findall(masked)
    if not masked.isascii() and _CJK.search(masked):
        words = [w for x in words for w in ([x[i : i + 2] for i in range(max(1, len(x) - 1))] if _CJK.search(x) else [x])]
    return list(map(_CODES.__getitem__, words))


def _grams(words: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Places in the weights of every line's words, pairs of neighbours, first and last word, and the line of each."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    code = np.fromiter((c for w in words for c in w), np.uint64, int(n.sum()))
    line = np.repeat(np.arange(len(n)), n)
    end = np.cumsum(n)
    some = n > 0
    pair = np.flatnonzero(line[1:] == line[:-1])
    first, last = code[(end - n)[some]], code[end[some] - 1]
    held = np.concatenate([code, mix(code[pair] << np.uint64(32) | code[pair + 1]), mix(first ^ np.uint64(1 << 33)), mix(last ^ np.uint64(1 << 34))])
    return (held & np.uint64((1 << SPACE_BITS) - 1)).astype(np.int64), np.concatenate([line, line[pair], np.flatnonzero(some), np.flatnonzero(some)])


def page_lines(text: str, site: re.Pattern | None, features: bool = True) -> list[tuple]:
    """Of each line that isn't blank: number, shape, hash whole, hash of its start, dense features, hashes of its words."""
    lines = [(n, x.strip()) for n, x in enumerate(text.split("\n"), 1) if x.strip()]
    bullets = [_BULLET.match(x) for _, x in lines]
    bares = [x[m.end() :] if m else x for m, (_, x) in zip(bullets, lines)]
    shapes = [shape_of(x) for x in bares]
    out = []
    for k, ((n, x), bullet, bare, shape) in enumerate(zip(lines, bullets, bares, shapes)):
        masked = site.sub("§", bare) if site else bare
        masked = " ".join(_DIGITS.sub("9", masked).split()).casefold()
        colon = _COLON.match(masked)
        start = colon[0] if colon else masked[:5] if not masked.isascii() and _CJK.search(masked) else " ".join(m[0] for m in islice(_WORD.finditer(masked), 3))
        if not features:
            out.append((n, shape, _hash(masked), _hash("^" + start), None, None))
            continue
        words = _words(masked)
        dense = [
            1.0, float(shape == PARAGRAPH), float(shape == HEADLINE), float(shape == LABEL), float(bool(bullet)), math.log1p(len(x)) / 5, min(_separators(x), 6) / 3,
            float("©" in x), float("§" in masked), float(k == 0), float(k == len(lines) - 1), k / max(1, len(lines) - 1), float(bool(colon)),
            float(k > 0 and shapes[k - 1] == PARAGRAPH), float(k + 1 < len(lines) and shapes[k + 1] == PARAGRAPH), min(len(words), 30) / 15,
        ]
        out.append((n, shape, _hash(masked), _hash("^" + start), dense, words))
    return out


def _texts(f: pd.DataFrame, sites: dict[tuple, re.Pattern | None]) -> Iterator[tuple]:
    """Of each item its number, title, site and the texts that have several lines."""
    for seq, title, source, host, *texts in zip(f["item_seq"], f["title"], f["source"], f["host"], f["content"], f["fulltext"]):
        site = sites[source, host] if (source, host) in sites else sites.setdefault((source, host), _site(source, host))
        yield seq, title, source, site, [(field, text) for field, text in zip(("content", "fulltext"), texts) if text and "\n" in text.strip()]


def _keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each page the hashes of its lines and their beginnings, how often it has them, and how often between paragraphs."""
    sites: dict[tuple, re.Pattern | None] = {}
    for f in frames:
        out: tuple[list[int], ...] = ([], [], [], [], [])
        for _, title, source, site, texts in _texts(f, sites):
            held: dict[int, list[int]] = {}
            for _, text in texts:
                lines = page_lines(text, site, False)
                shapes = [x[1] for x in lines]
                for k, (_, _, whole, start, _, _) in enumerate(lines):
                    mid = 0 < k < len(shapes) - 1 and shapes[k - 1] == shapes[k + 1] == PARAGRAPH
                    for key in (whole, start):
                        n = held.setdefault(key, [0, 0])
                        n[0] += 1
                        n[1] += mid
            if held:
                out[0].extend(held)
                out[1].extend([_matter(title)] * len(held))
                out[2].extend([_hash("\0".join((title or "", source or "", *(f"{field}\0{text}" for field, text in texts))))] * len(held))
                out[3].extend(n for n, _ in held.values())
                out[4].extend(mid for _, mid in held.values())
        yield pd.DataFrame(dict(zip(("key", "matter", "page", "n", "mid"), out)))


def _rows(frames: Iterator[pd.DataFrame], weights: np.ndarray | None) -> Iterator[pd.DataFrame]:
    """Narrow rows of lines; with weights the share of the score that the text alone gives, else its features."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    sites: dict[tuple, re.Pattern | None] = {}
    own = [] if weights is None else weights[:DENSE].tolist()
    for f in frames:
        out, said = [], []
        for seq, _, _, site, texts in _texts(f, sites):
            for field, text in texts:
                for n, shape, whole, start, dense, words in page_lines(text, site):
                    logit = 0.0 if weights is None else sum(map(mul, own, dense))
                    said.append(words)
                    out.append((seq, field, n, shape, logit, whole, start, dense if weights is None else None, words if weights is None else None))
        rows = pd.DataFrame(out, columns=names)
        if weights is not None:
            at, line = _grams(said)
            rows["logit"] += np.bincount(line, weights[DENSE + STATS :][at], len(said)) / np.sqrt(np.bincount(line, minlength=len(said)) + 1)
        yield rows


def expected_matters(titles: pd.DataFrame, pages: np.ndarray) -> np.ndarray:
    """Different matters that so many pages have if taken at random; ``titles``: of how many matters (of) as many titles (count) are.

    Titles share words, so the matters of many pages are ever fewer than the pages.
    """
    count, of = titles["count"].to_numpy(float), titles["of"].to_numpy(float)
    n = max(1.0, (count * of).sum())
    grid = np.geomspace(1, n, 200) if n > 1 else np.ones(1)
    many = np.array([(of * (1 - (1 - min(1.0, x / n)) ** count)).sum() for x in grid]) if len(of) else np.ones(1)
    return np.maximum(1.0, np.exp(np.interp(np.log(pages), np.log(grid), np.log(many))))


def _stat_features(f: dict) -> list[float]:
    """Features of how a line and its beginning recur."""
    out = []
    for k in ("w", "s"):
        n, matters, mid, many = (f[f"{k}_{c}"] or 0 for c in COUNTS)
        out += [math.log1p(matters), matters / many if n else 0.0, mid / n if n else 0.0]
    return out


@dataclass
class Potentials:
    weights: np.ndarray
    child: np.ndarray  # (shape of the block, block's class, line's class)
    under: np.ndarray  # (class of the short line, class of the headlines under it)
    block: np.ndarray  # (shape, class)
    share: float


def _blocks(shapes: list[int]) -> list[list[int]]:
    out: list[list[int]] = []
    for i, s in enumerate(shapes):
        if out and shapes[out[-1][0]] == s:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def marginals(shapes: list[int], logits: list[float], p: Potentials) -> list[float]:
    """Probability of each line not to be part of the article, by messages up and down the page's tree."""
    prior = math.log(p.share / (1 - p.share))
    own = []
    for x in logits:
        q = 1 / (1 + math.exp(-max(-30.0, min(30.0, x - prior))))
        own.append(np.array([1 - q, q]))
    blocks = _blocks(shapes)
    up: list[np.ndarray | None] = [None] * len(blocks)  # a block's message to what it hangs on
    into: dict[int, int] = {}  # short line -> block of headlines under it
    for b, held in enumerate(blocks):
        if shapes[held[0]] == HEADLINE and b and shapes[blocks[b - 1][-1]] == LABEL:
            into[blocks[b - 1][-1]] = b
    hanging = set(into.values())

    def line_up(i: int) -> np.ndarray:
        return own[i] * up[into[i]] if i in into else own[i]

    inside: list[np.ndarray] = [np.ones(2)] * len(blocks)
    to_block: dict[int, np.ndarray] = {}
    for b in range(len(blocks) - 1, -1, -1):
        table_ = p.child[shapes[blocks[b][0]]]
        total = np.ones(2)
        for i in blocks[b]:
            m = table_ @ line_up(i)
            to_block[i] = m / m.sum()
            total = total * to_block[i]
            total = total / total.sum()
        inside[b] = total
        if b in hanging:
            m = p.under @ total
            up[b] = m / m.sum()
    out = [0.0] * len(shapes)
    down: dict[int, np.ndarray] = {}
    for b, held in enumerate(blocks):
        top = down[b] if b in hanging else p.block[shapes[held[0]]]
        belief = top * inside[b]
        for i in held:
            rest = belief / np.maximum(to_block[i], 1e-12)
            rest = rest / rest.sum()
            above = rest @ p.child[shapes[held[0]]]
            if i in into:
                m = (above * own[i]) @ p.under
                down[into[i]] = m / m.sum()
            q = above * line_up(i)
            out[i] = float(q[1] / q.sum())
    return out


def _label(page: pd.DataFrame) -> list[int | None]:
    """1: not the article, 0: the article, None: left open."""
    out: list[int | None] = []
    rows = page.to_dict("records")
    recurs = lambda r, k: (r[k + "_matters"] or 0) >= MATTERS and (r[k + "_matters"] or 0) >= 0.3 * (r[k + "_many"] or 1)
    parts = lambda r, k: (r[k + "_n"] or 0) >= 3 and (r[k + "_mid"] or 0) >= 0.9 * r[k + "_n"]
    for n, r in enumerate(rows):
        if r["shape"] == LABEL and (parts(r, "w") or parts(r, "s")):
            out.append(0)
        elif recurs(r, "w"):
            out.append(1)
        elif r["shape"] == HEADLINE and (out and out[-1] == 1 and rows[n - 1]["shape"] in (LABEL, HEADLINE) or recurs(r, "s") and r["dense"][12]):
            out.append(1)
        elif r["shape"] == PARAGRAPH and (r["w_matters"] or 0) <= 2:
            out.append(0)
        elif r["shape"] == HEADLINE and n == len(rows) - 1 and rows[n - 1]["shape"] == PARAGRAPH:
            out.append(0)
        else:
            out.append(None)
    return out


def fit(sample: pd.DataFrame, rounds: int = 400) -> Potentials:
    """Potentials from the lines of whole pages with their statistics."""
    x, g, y, tables = [], [], [], (np.ones((3, 2, 2)) + 3 * np.eye(2), np.ones((2, 2)) + np.eye(2), np.ones((3, 2)))
    child, under, block = tables
    for _, page in sample.groupby(["item_seq", "field"], sort=True):
        page = page.sort_values("line")
        labels, shapes = _label(page), page["shape"].tolist()
        for r, label in zip(page.to_dict("records"), labels):
            if label is not None:
                x.append([*r["dense"], *_stat_features(r)])
                g.append(r["words"])
                y.append(label)
        groups = _blocks(shapes)
        kinds = []
        for held in groups:
            known = [labels[i] for i in held if labels[i] is not None]
            kinds.append(None if not known else int(sum(known) * 2 >= len(known)))
            if kinds[-1] is not None:
                block[shapes[held[0]], kinds[-1]] += 1
                for v in known:
                    child[shapes[held[0]], kinds[-1], v] += 1
        for b, held in enumerate(groups):
            if b and shapes[held[0]] == HEADLINE and shapes[groups[b - 1][-1]] == LABEL and kinds[b] is not None and labels[groups[b - 1][-1]] is not None:
                under[labels[groups[b - 1][-1]], kinds[b]] += 1
    size = DENSE + STATS + (1 << SPACE_BITS)
    w = np.zeros(size)
    share = 0.5
    if y:
        x_, y_ = np.array(x), np.array(y, float)
        col, row = _grams(g)
        scale = 1 / np.sqrt(np.bincount(row, minlength=len(g)) + 1)
        share = float(np.clip(y_.mean(), 0.05, 0.95))
        first, second = np.zeros(size), np.zeros(size)
        for t in range(1, rounds + 1):  # Adam on the whole sample
            z = x_ @ w[: DENSE + STATS] + np.bincount(row, w[DENSE + STATS :][col], len(y_)) * scale
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y_) / len(y_)
            grad = np.concatenate([x_.T @ e, np.bincount(col, (e * scale)[row], 1 << SPACE_BITS)]) + 2e-6 * w
            first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
            w -= 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    child = (child / child.sum(2, keepdims=True)) ** TEMPER
    return Potentials(w, child / child.sum(2, keepdims=True), under / under.sum(1, keepdims=True), block / block.sum(1, keepdims=True), share)


def _with_stats(lines: DataFrame, stats: DataFrame) -> DataFrame:
    for column, k in (("whole", "w"), ("start", "s")):
        own = stats.select(F.col("key").alias(column), *(F.col(c).alias(f"{k}_{c}") for c in COUNTS))
        lines = lines.join(own, column, "left")
    return lines


def boilerplate_lines(pages: DataFrame) -> DataFrame:
    """(item_seq, field, line_no, p) of every non-blank line of ``content`` and ``fulltext`` that has company.

    ``pages``: item_seq, title, source, host, content, fulltext; p is the probability that the line is not part of the
    article. Null, empty and one-line texts have no rows. Rows repeated under one item_seq count once; other columns
    are ignored.
    """
    titles = pages.select("title").distinct()
    pages = pages.select("item_seq", "title", "source", "host", "content", "fulltext").where("content like '%\\n%' or fulltext like '%\\n%'")
    titles = titles.mapInPandas(lambda frames: (pd.DataFrame({"matter": [_matter(t) for t in f["title"]]}, dtype="int64") for f in frames), "matter long")
    titles = titles.groupBy("matter").count().groupBy("count").agg(F.count("*").alias("of")).toPandas()  # one row a different count
    # Copies of a page tell nothing that it doesn't, so they count once.
    each = pages.mapInPandas(_keys, "key long, matter long, page long, n int, mid int").dropDuplicates(["key", "page"])
    each = each.groupBy("key", "matter").agg(F.sum("n").alias("n"), F.sum("mid").alias("mid"), F.count("*").alias("pages"))
    each = each.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("matters"), F.sum("mid").alias("mid"), F.sum("pages").alias("pages")).where("n > 1")
    many = lambda frames: (f.assign(many=expected_matters(titles, f["pages"].to_numpy(float)))[["key", *COUNTS]] for f in frames)
    stats = cut(each.mapInPandas(many, "key long, n long, matters long, mid long, many double"))
    # Two texts an item at most; the ids are chosen without the texts, and there are no more of them than the bound.
    chosen = pages.select("item_seq").orderBy(F.xxhash64("item_seq", F.lit(11)), "item_seq").limit(TRAIN_PAGES // 2).distinct()
    some = pages.join(F.broadcast(chosen), "item_seq", "left_semi")
    sample = _with_stats(some.mapInPandas(lambda f: _rows(f, None), SCHEMA), stats)
    counts = [f"{k}_{c}" for k in "ws" for c in COUNTS]
    fitted = fit(sample.fillna(0, counts).toPandas())
    kept = pages.sparkSession.sparkContext.broadcast(fitted)
    lines = pages.mapInPandas(lambda f: _rows(f, kept.value.weights), SCHEMA).drop("dense", "words")
    line = F.struct("line", "shape", "logit", *counts)
    whole = _with_stats(lines, stats).fillna(0, counts).groupBy("item_seq", "field").agg(F.sort_array(F.collect_set(line)).alias("lines"))

    def infer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = kept.value
        for f in frames:
            out = []
            for seq, field, lines_ in zip(f["item_seq"], f["field"], f["lines"]):
                rows = [r if isinstance(r, dict) else r.asDict() for r in lines_]
                score = [r["logit"] + float(np.dot(p.weights[DENSE : DENSE + STATS], _stat_features(r))) for r in rows]
                for r, q in zip(rows, marginals([r["shape"] for r in rows], score, p)):
                    out.append((seq, field, r["line"], q))
            yield pd.DataFrame(out, columns=["item_seq", "field", "line_no", "p"])

    return whole.mapInPandas(infer, "item_seq long, field string, line_no int, p double")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "news_items").select("item_seq", "title", "source", "content", F.get_json_object("facts", "$.fulltext.text").alias("fulltext"))
    hosts = table(spark, sf_dir, "sources").select(F.col("id").alias("source"), "host").dropDuplicates(["source"])
    return items.join(hosts, "source", "left")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p2_found of TESTDATA.md."""
    lines = boilerplate_lines(_pages(spark, sf_dir)).where("p > 0.5").select("item_seq", "field", "line_no")
    cases = residue.found(spark, sf_dir).where("field = 'content'").distinct()
    return lines.join(cases, ["item_seq", "field"], "left_anti")
