import random
import re
import shutil
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

llm = pytest.importorskip("dispatchlake.llm")

from dispatchlake.llm import boilerplate, components, encode, history, lookalike, packing, residue, spans, vectors  # noqa: E402


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# p3


def test_groups_against_union_find(spark):
    rng = random.Random(3)
    edges = [(f"v{rng.randrange(300):03}", f"v{rng.randrange(300):03}") for _ in range(260)] + [("v000", f"h{i:03}") for i in range(150)] + [("x", None), (None, "y"), ("z", "z"), ("v001", "v002"), ("v002", "v001")]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            a, b = sorted((find(a), find(b)))
            up[b] = a
    df = spark.createDataFrame([(a, b, 1) for a, b in edges], "a string, b string, group int")
    assert rows(components.connected_groups(df)) == sorted((x, find(x)) for x in up)
    assert rows(components.connected_groups(df.limit(0))) == []
    assert rows(components.connected_groups(df.where("a = 'z'"))) == []


def test_long_chain(spark):
    df = spark.createDataFrame([(f"{i:04}", f"{i + 1:04}") for i in range(400)], "a string, b string")
    assert {r.group for r in components.connected_groups(df).collect()} == {"0000"}


# p8


def test_encoding_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(encode.VOCABULARY)
    t.encode_special_tokens = True
    rng = random.Random(1)
    texts = ["", None, " ", "aaaaaaaaaaaa", "<|endoftext|>", "x²½Ⅷ \x1c y\x85z  　 ​ é 'S's we'll", "😀😀 नमस्ते", "\r\n\t x", "a" * 20_000, "字" * 5000]
    texts += ["".join(rng.choice("abcde fghi's ,.0123éжß中\n") for _ in range(rng.randrange(200))) for _ in range(150)]
    df = spark.createDataFrame([(i, x, None) for i, x in enumerate(texts)] + [(0, "", None)], "doc_id long, text string, ids string")
    got = defaultdict(list)
    for r in encode.encode_texts(df, "doc_id", "text").collect():
        got[r.doc_id].append(r.ids)
    assert len(got[0]) == 2
    want = [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    assert all(got[i][0] == want[i] for i in range(len(texts)))
    counted = {r.doc_id: r.n_tokens for r in encode.count_tokens(df, "doc_id", "text").collect()}
    assert counted == {i: len(w) for i, w in enumerate(want)}
    assert encode.encode_texts(df.limit(0), "doc_id", "text").count() == 0


# p9


def test_packing(spark):
    rng = random.Random(2)
    items = [(i, rng.choice((1, 5, 30, 100, 260, 512, 1100)) + rng.randrange(40)) for i in range(900)] + [(1000, 0), (1001, None), (None, 7), (5, 1)]
    df = spark.createDataFrame(items, "doc_id long, n_tokens long")
    out = packing.pack_containers(df, [("s", 512), ("none", None)], group=250).toPandas()
    size = {i: n for i, n in items[:900]}
    each = out.groupby("doc_id")
    assert each.n_tokens.sum().to_dict() == size
    assert all(n > 512 or len(g) == 1 for (i, g) in each for n in [size[i]])
    fill = out.groupby("container").n_tokens.sum()
    assert fill.max() <= 512 and (out.fill == out.container.map(fill)).all()
    assert len(fill) <= 1.05 * (sum(size.values()) / 512) + 4
    assert packing.pack_containers(df.limit(0), [("s", 512)]).count() == 0


def test_local_search_empties_containers():
    rng = random.Random(9)
    for _ in range(30):
        sizes = [rng.randrange(1, 60) for _ in range(80)]
        start = packing.fill_greedily(sizes, 100)
        end = packing.pack(sizes, 100)
        assert sorted(i for b in end for i in b) == list(range(80))
        assert max(sum(sizes[i] for i in b) for b in end) <= 100 and len(end) <= len(start)


# p10


def brute_spans(texts, span):
    seen = defaultdict(set)
    for i, t in texts:
        for p in range(len(t) - span + 1):
            seen[t[p : p + span]].add(i)
    out = set()
    for i, t in set(texts):
        cur = None
        for p in range(len(t) - span + 1):
            if len(seen[t[p : p + span]]) > 1:
                if cur and p <= cur[1]:
                    cur[1] = p + span
                else:
                    if cur:
                        out.add((i, *cur))
                    cur = [p, p + span]
        if cur:
            out.add((i, *cur))
    return sorted(out)


def test_spans_against_all_windows(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("ab cdé字😀") for _ in range(n))
    shared = [word(rng.randrange(15, 90)) for _ in range(8)]
    texts = [(i, "".join(rng.choice((word(rng.randrange(40)), rng.choice(shared), rng.choice(shared)[5:40])) for _ in range(rng.randrange(6)))) for i in range(60)]
    texts += [(70, "a" * 300), (71, "b" + "a" * 250), (72, "ab" * 90 + "ab" * 90), (73, texts[5][1]), (74, word(50) * 2)]
    df = spark.createDataFrame([(i, t, 0) for i, t in texts] + [(80, None, 0), (None, "a" * 300, 0), (70, "a" * 300, 0)], "doc_id long, text string, run int")
    for span in (20, 33):
        assert rows(spans.merge_spans(spans.shared_marks(df, span))) == brute_spans(texts, span)
    assert rows(spans.merge_spans(spans.shared_marks(df.limit(0), 20))) == []


# p5


def test_similar_pairs_against_all_pairs(spark):
    rng = np.random.default_rng(7)
    base = rng.standard_normal((300, 16))
    near = base[:80] + 0.05 * rng.standard_normal((80, 16))
    x = np.concatenate([base, near, np.repeat(base[:1], 40, 0), np.zeros((1, 16))]).astype(np.float32)
    data = [(i, v.tolist(), "m", 1.0) for i, v in enumerate(x)] + [(900, None, "m", 1.0), (901, [], "m", 1.0), (902, base[1][:8].tolist(), "m", 1.0), (903, base[1].tolist(), "other", 1.0), (904, base[2].tolist(), None, 1.0), (905, [float("nan")] * 16, "m", 1.0), (3, x[3].tolist(), "m", 1.0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, model string, cosine double")
    u = x[:-1].astype(float) / np.linalg.norm(x[:-1].astype(float), axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i in range(len(u)) for j in sorted(range(len(u)), key=lambda j: (-round(s[i, j], 9), j))[:10] if s[i, j] >= 0.9}
    got = {(r.vec_id, r.other) for r in vectors.similar_pairs(df).collect()}
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)
    asked = {(r.vec_id, r.other) for r in vectors.similar_pairs(df.withColumn("q", F.col("vec_id") < 20), asks="q").collect()}
    assert {p for p in asked if p[0] < 20} >= {p for p in want if 0 < p[0] < 20 and p[1] > 20 and p[1] < 380}
    assert vectors.similar_pairs(df.limit(0)).count() == 0


def test_top_k_recall(spark):
    x = np.random.default_rng(1).standard_normal((1500, 24)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), "m") for i, v in enumerate(x)], "vec_id long, embedding array<float>, model string")
    got = defaultdict(set)
    for r in vectors.top_k(df.where("vec_id % 20 = 0"), df, block=700).collect():
        got[r.vec_id].add(r.other)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -2)
    hits = sum(len(got[i] & set(np.argsort(-s[i])[:10].tolist())) for i in range(0, 1500, 20))
    assert hits >= 0.9 * 750


# p6


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("Ｍｉｌｏ ２", "Milo 2", True), ("Тrade", "Trade", True), ("café", "café", True), ("a​b­c", "abc", True), ("a b", "a b", True), ("ﬁn", "fin", True), ("5K", "5K", True),
        ("Trade", "trade", False), ("cafe", "café", False), ("a1", "al", False), ("a.", "a", False), ("a–b", "a-b", False), ("10", "1O", False),
    ],
)
def test_looks(a, b, same):
    assert (lookalike.skeleton(a) == lookalike.skeleton(b)) == same


def test_forms_follow_looks(spark):
    rng = random.Random(8)
    swaps = {"a": "аａ", "c": "с", "e": "е", "o": "оο", "p": "р", "x": "х", " ": " 　", "i": "і"}
    words = "copa сора пирожок ехо exo price Milo о".split()
    titles = [" ".join(rng.choice(words) for _ in range(3)) for _ in range(60)]
    titles += ["".join(rng.choice(swaps[c]) if c in swaps and rng.random() < 0.3 else c + rng.choice(("", "", "​")) for c in t) for t in titles] + ["", "​", None]
    df = spark.createDataFrame([("t", i, t, "clash") for i, t in enumerate(titles)] + [("t", 0, titles[0], "clash")], "field string, id long, title string, form string")
    got = {r.id: r.form for r in lookalike.canonical_titles(df).collect()}
    assert got[len(titles) - 1] is None and lookalike.canonical_titles(df).count() == len(titles) + 1
    known = [(i, t) for i, t in enumerate(titles) if t is not None]
    for i, a in known:
        for j, b in known:
            assert (got[i] == got[j]) == (lookalike.skeleton(a) == lookalike.skeleton(b)), (a, b)
    assert any(f and all("Ѐ" <= c <= "ӿ" for c in f.replace(" ", "")) for f in got.values())
    assert lookalike.canonical_titles(df.limit(0)).count() == 0


# p7


def test_residue(spark):
    items = [
        (1, "404 Not Found", "A proper text about boats in the harbour of Orun."), (2, "Boats", "{{ item.lead }} sail"), (3, "Boats", "Lorem ipsum dolor sit amet consectetur."), (4, None, ""), (5, "Boats", None),
        (6, "Access denied was the most common message in Orun", "The template language writes a variable as `{{ name }}`, and Ada noted it."), (7, "Morning brief No. 3", "x"), (8, "Boats", "Please enable JavaScript to view this page.\nRay 1f2e3d4c5b6a"),
        (9, "__TITLE__", "They sail on."), (10, "Boats", "Designers stopped using lorem ipsum after a review of many drafts."), (1, "404 Not Found", "A proper text about boats in the harbour of Orun."), (11, "Boats", "null"), (12, "Boats", "word " * 30_000),
    ]
    # A page text that stands once is no case: what recurs over unrelated records is learned.
    items += [(20 + i, t, "Please enable JavaScript to view this page.") for i, t in enumerate(("Trains leave late", "Rain in Orun", "No news today"))]
    df = spark.createDataFrame([(*x, "clash") for x in items], "item_seq long, title string, content string, field string")
    assert rows(residue.residue(df)) == sorted([(1, "title"), (2, "content"), (3, "content"), (8, "content"), (9, "title"), (11, "content"), (20, "content"), (21, "content"), (22, "content")])
    assert residue.residue(df.where("item_seq < 20")).where("item_seq = 8").count() == 0
    assert residue.residue(df.limit(0)).count() == 0


def test_pages_grow_from_known_units(spark):
    items = [(i, f"Story {i} of the {w}", "Internal Server Error. Kindly come back tomorrow.") for i, w in enumerate("alpha beta".split())]
    found = lambda x: rows(residue.residue(spark.createDataFrame(x, "item_seq long, title string, content string")))
    assert found(items) == [(i, "content") for i in range(2)]
    assert found(items + [(9, "Other", "Kindly come back tomorrow.")]) == []


def test_long_error_pages(spark):
    lines = ["500 Internal Server Error"] + [f"The machine {w} could not finish what your browser had asked it to do for you" for w in "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()]
    page, notice = ". ".join(lines) + ".\nRay ", "\n".join(f"Readers of the {w} edition will find what they asked for here soon" for w in lines)
    items = [(i, f"Boats{i} come home", page + f"{i + 7}f2e3d4c5b6a") for i in range(8)] + [(i, f"Ships{i} come home", notice) for i in range(10, 18)]
    items += [(i, f"Trains{i} come home", "Access denied.\n" + " ".join(f"They w{chr(97 + i % 26)}{chr(97 + k)}x the harbour of Orun and went on." for k in range(20))) for i in range(20, 30)]
    items += [(i, "Trains come home", " ".join(f"They went to the harbour of town{k} and went on." for k in "abcdefghijklmnop")) for i in range(30, 40)]
    found = rows(residue.residue(spark.createDataFrame(items, "item_seq long, title string, content string")))
    assert len(page) > 500 and found == [(i, "content") for i in [*range(8), *range(10, 18)]]


def test_one_template_in_thousands_of_records(spark):
    items = [(i, f"Story{i} of day", "By {{author_name}} in {{category}}\nThey sail on.") for i in range(3000)] + [(i, "News from ${city} today", f"Boats{i} came home.") for i in range(3000, 3100)]
    items += [(i, f"Engine{i} of choice", f"In town{i}" + " a page writes the variable as {{ name }} and goes on.") for i in range(4000, 4010)]
    found = rows(residue.residue(spark.createDataFrame(items, "item_seq long, title string, content string")))
    assert found == [(i, "content") for i in range(3000)] + [(i, "title") for i in range(3000, 3100)]


def test_templates_of_unknown_words(spark):
    """Slots and page texts in invented words, which no list can hold."""
    find = lambda x: rows(residue.residue(spark.createDataFrame(x, "item_seq long, title string, content string")))
    filled = [(i, f"Story{i} of the day", f"By {n} in {c} for the evening edition\nBoats of pier{i} sail on.") for i, (n, c) in enumerate(zip("Ada Bo Cyd Dee Eve Flo".split(), "Sports Markets Science Culture Travel Food".split()))]
    hollow = [(10, "Trains run late", "By undefined in null for the evening edition\nTrains wait."), (11, "Cars wait", "By author_name in Sports for the evening edition\nCars wait."), (12, "Ships sink", "By  Ada in  for the evening edition\nShips sink.")]
    spoken = [(13, "Values", "Each lookup gave null in the end and the test went on.\nIt was late."), (14, "Names", "Ada calls it user_name in her book about Orun.\nIt sold well.")]
    assert find(filled + hollow + spoken) == [(i, "content") for i in (10, 11, 12)]
    # A notation that wraps what known notations wrap is induced; in quotes it is talked about.
    signs = [(i, f"Boats{i} at pier", f"Told by {a}{w}{b} at the pier of town{i}.") for i, (a, w, b) in enumerate([("{{", "pilot", "}}"), ("${", "vessel", "}"), ("@@", "pilot", "@@"), ("@@", "vessel", "@@"), ("~", "Orun", "~"), ("~", "Ada", "~"), ("\"@@", "pilot", "@@\"")])]
    assert find(signs) == [(i, "content") for i in range(4)]
    page = [(i, f"{w} story told", "Brel nok tavi, surru 503 melk.") for i, w in enumerate("alpha beta gamma delta".split())] + [(9, "Brel nok tavi, surru 504 melk.", "Boats sail on to Orun."), (10, "epsilon story", "Brel nok tavi, surru 500 melk.\nTrako 1f2e3d4c5b6a"), (11, "zeta story", "Brel nok tavi, surru 500 melk. Brel nok tavi, surru 500 melk. Trako: 1f2e3d4c5b6a")]
    series = [(20 + i, f"Dawn letter No. {i}", f"Boats of pier{i} sail on.") for i in range(12)]
    assert find(page + series) == [*((i, "content") for i in range(4)), (9, "title"), (10, "content"), (11, "content")]


def test_units_end_at_stops():
    """The quick way to cut units gives what the rule says: blanks after a stop, a wide stop, or the end of a line."""
    rng = random.Random(14)
    for _ in range(5000):
        t = "".join(rng.choice(" \n\t.!?…。！？a1\u3000") for _ in range(rng.randrange(12)))
        assert residue._units(t) == re.split(r"(?<=[.!?…])\s+|(?<=。)|(?<=！)|(?<=？)|\n", t), t


# p4


def story_items():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    texts = [" ".join(word() for _ in range(80)) for _ in range(30)]
    items = [(i, 0, f"id{i:03}", f"title {word()}", t, "en", f"https://e.org/{i}") for i, t in enumerate(texts)]
    change = lambda t, n: " ".join(word() if k % (80 // n) == 0 else w for k, w in enumerate(t.split()))
    items += [
        (100, 1, "id100", items[3][3], change(texts[3], 6), "en", "https://e.org/n100"), (101, 1, "id101", "other", "new " + word(), "en", "HTTPS://E.org:443/5/?utm_source=x#y"), (102, 2, "id102", items[7][3].upper(), texts[7], "en", None),
        (103, 2, "id103", items[3][3], change(texts[3], 5), "en", ""), (104, 2, "id104", "fresh", " ".join(word() for _ in range(50)), None, ""), (105, 3, "id105", None, None, None, None), (106, 3, "id106", None, "", "zh", None), (107, 3, "id107", "t", "503 Service Unavailable\nRay 1f2e3d4c5b6a", "en", "https://e.org/1"), (108, None, "id108", "late history", word(), "en", "https://e.org/h"),
    ]
    return items + [items[30]]


def test_repeats(spark):
    df = spark.createDataFrame([(*x, "clash") for x in story_items()], "item_seq long, batch_no int, item_id string, title string, content string, lang string, url string, seq string")
    rng = np.random.default_rng(2)
    v = rng.standard_normal((2, 8)).astype(np.float32)
    vecs = spark.createDataFrame([(1, "id009", v[0].tolist(), "m"), (2, "id104", (v[0] * 3 + 0.01).tolist(), "m"), (3, "id004", v[1].tolist(), "m"), (4, "id010", None, "m"), (5, None, v[1].tolist(), "m")], "vec_id long, item_id string, embedding array<float>, model string")
    assert rows(history.repeats(df, vecs)) == sorted([(3, 100), (5, 101), (7, 102), (3, 103), (9, 104), (105, 106)])
    assert history.repeats(df.limit(0), vecs.limit(0)).count() == 0


def test_brief_texts_share_a_key():
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    shared = lambda a, b, zh: len(np.intersect1d(history.fingerprints(a, zh), history.fingerprints(b, zh))) > 0
    for n in range(7, 60):
        for zh in (False, True):
            for _ in range(20):
                a = [word() for _ in range(n)]
                b = list(a)
                for k in rng.sample(range(n), int(0.15 * n)):
                    b[k] = word()
                assert shared(a, b, zh), (n, zh)
                c = [w for k, w in enumerate(a) if n > 19 or k != n // 2]
                assert n > 19 or shared(a, c, zh)
    long = [word() for _ in range(140)]
    assert shared(long, [word() if k % 7 == 6 else w for k, w in enumerate(long)], True)


def test_more_near_vectors_than_ten(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal(32)
    near = v + 0.08 * rng.standard_normal((120, 32))
    u = near / np.linalg.norm(near, axis=1)[:, None]
    assert (u @ u.T).min() > 0.93
    pairs = [(i, j) for i in range(120) for j in range(i) if u[i] @ u[j] >= 0.98]
    word = lambda i: "".join(chr(97 + int(x)) for x in np.random.default_rng(i).integers(0, 26, 12))
    items = spark.createDataFrame([(i, 0 if i < 5 else 1, f"id{i}", f"{word(i)} {word(i + 500)}", f"{word(i + 1000)} {word(i + 2000)}", "en", None) for i in range(120)], "item_seq long, batch_no int, item_id string, title string, content string, lang string, url string")
    vecs = spark.createDataFrame([(500 - i, f"id{i}", x.tolist(), "m") for i, x in enumerate(near.astype(np.float32))], "vec_id long, item_id string, embedding array<float>, model string")
    up = list(range(120))
    for _ in range(120):
        for i, j in pairs:
            up[i] = up[j] = min(up[i], up[j])
    assert max(sum(j in p for p in pairs) for j in range(120)) > 20
    assert rows(history.repeats(items, vecs)) == sorted((up[i], i) for i in {i for i, _ in pairs} if i >= 5)


def test_batches_one_by_one_equal_all_at_once(spark, tmp_path):
    items = spark.createDataFrame(story_items(), "item_seq long, batch_no int, item_id string, title string, content string, lang string, url string").fillna({"batch_no": 0})
    none = spark.createDataFrame([], "item_seq long")
    together, single = history.History(spark, str(tmp_path / "a")), history.History(spark, str(tmp_path / "b"))
    for part in ("batch_no = 0", "batch_no > 0"):
        together.add(items.where(part), none)
    for n in range(4):
        single.add(items.where(f"batch_no = {n}"), none)
    assert rows(history.stories(together.links())) == rows(history.stories(single.links()))


def test_every_holder_of_a_fingerprint_counts(spark):
    """A later text near to the second of three versions is found though the first holds most of its runs and is too far."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    a = [word() for _ in range(120)]
    b = [word() if k in (50, 51, 52, 53, 54, 55) else w for k, w in enumerate(a)]
    c = [word() if k in range(0, 14) else w for k, w in enumerate(b)]
    assert history.distance(a, b) < 0.15 < history.distance(a, c) and history.distance(b, c) < 0.15
    items = [(n, min(n, 1), f"id{n}", "", " ".join(t), "en", None) for n, t in enumerate((a, b, c))]
    df = spark.createDataFrame(items, "item_seq long, batch_no int, item_id string, title string, content string, lang string, url string")
    vecs = spark.createDataFrame([], "vec_id long, item_id string, embedding array<float>, model string")
    assert rows(history.repeats(df, vecs)) == [(0, 1), (0, 2)]
    assert rows(history.stories(spark.createDataFrame([(9, 7), (9, 8), (8, 2)], "seq long, first long"))) == [(8, 2), (9, 2)]


def test_common_lines_hide_no_repeat(spark):
    """Texts of little but a notice that many carry are joined on their rarest words, against brute force."""
    rng = random.Random(9)
    notice = "we use cookies on this site and you agree to all of them by going on reading what is below here now"
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9)))
    texts = [f"{notice} {word()} {word()} {word()} {word()} {word()} {word()}" for _ in range(120)]
    texts += [" ".join(word() if rng.random() < 0.06 else w for w in t.split()) for t in rng.sample(texts, 60)]
    df = spark.createDataFrame([(n, int(n >= 60), f"id{n}", "", t, "en", None) for n, t in enumerate(texts)], "item_seq long, batch_no int, item_id string, title string, content string, lang string, url string")
    got = rows(history.repeats(df, spark.createDataFrame([], "vec_id long, item_id string, embedding array<float>, model string")))
    up = list(range(len(texts)))
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if history.distance(texts[i].split(), texts[j].split()) <= 0.15]
    for _ in texts:
        for i, j in pairs:
            up[i] = up[j] = min(up[i], up[j])
    assert len(pairs) > 30 and got == sorted((up[i], i) for i in {i for i, _ in pairs} if i >= 60)


@pytest.mark.parametrize("hot", [2, 16_384])
def test_no_pair_needs_a_common_run(spark, monkeypatch, hot):
    """Versions without a common run of words, many of one template, are found in two batches, against brute force."""
    monkeypatch.setattr(history, "HOT", hot)
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    template = [word() for _ in range(60)]
    texts = [[*template, *(word() for _ in range(40))] for _ in range(12)] + [[word() for _ in range(n)] for n in (1, 2, 3, 7, 20, 130)]
    texts += [rng.sample([word() if rng.random() < 0.1 else w for w in t], len(t)) for t in texts]
    df = spark.createDataFrame([(n, int(n >= 18), f"id{n}", "", " ".join(t), "en", None) for n, t in enumerate(texts)], "item_seq long, batch_no int, item_id string, title string, content string, lang string, url string")
    got = rows(history.repeats(df, spark.createDataFrame([], "vec_id long, item_id string, embedding array<float>, model string")))
    up = list(range(len(texts)))
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if history.distance(texts[i], texts[j]) <= 0.15]
    for _ in texts:
        for i, j in pairs:
            up[i] = up[j] = min(up[i], up[j])
    assert len(pairs) > 10 and got == sorted((up[i], i) for i in {i for i, _ in pairs} if i >= 18)


def test_bits_tell_long_texts_apart():
    """Unrelated texts of some hundred characters differ in more places than near ones may, so that few pairs are left to verify."""
    rng = np.random.default_rng(11)
    text = lambda: history.counted(history._hashes([chr(0x4E00 + int(x)) for x in rng.integers(0, 400, 500)]))
    bits = lambda h: np.unpackbits(np.frombuffer(bytes(history._bits(h)), np.uint8))
    a = [text() for _ in range(20)]
    near = a[0].copy()
    near[::7] = np.arange(len(near[::7]))
    assert (bits(a[0]) ^ bits(near)).sum() <= 2 * 0.15 * 500
    assert min((bits(a[i]) ^ bits(a[j])).sum() for i in range(20) for j in range(i)) > 2 * 0.15 * 500


def test_a_word_is_hashed_once(monkeypatch):
    """Words that come again take no second hash, and texts looked at together have what they have alone."""
    hashed, real = [], xxhash.xxh64_intdigest
    monkeypatch.setattr(history.xxhash, "xxh64_intdigest", lambda x: hashed.append(x) or real(x))
    rng = random.Random(13)
    texts = ["", *(" ".join(f"onceword{rng.randrange(60)}" for _ in range(n)) for n in (1, 2, 7, 40, 151, 152, 301, 700)), "Onceword1  \n ONCEWORD2", " onceword1 onceword2 "]
    columns = [list(range(len(texts))), [None] * len(texts), texts, ["en"] * len(texts), [None, "http://e.org/1", *[""] * (len(texts) - 2)]]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()))], names=list("abcde"))
    got = [r for b in history._profiles(history._NO_ORDER)([batch]) for r in b.to_pylist()]
    assert sum(b"onceword" in x for x in set(hashed)) > 50 and max(Counter(x for x in hashed if x.startswith(b"onceword")).values()) == 1
    for r, t in zip(got, texts, strict=True):
        h = history.counted(history._hashes(t.split()))
        assert r["n"] == len(t.split()) and sorted(r["words"]) == sorted(h.astype(np.uint32).view(np.int32).tolist())
        assert sorted(r["rare"]) == sorted(history.fingerprints(t.split(), False).tolist()) and r["bits"] == history._bits(h)
    assert got[-1]["exact"][2:] == got[-2]["exact"][2:] != got[-3]["exact"][2:] and got[0]["exact"][:2] == [None, None] != got[1]["exact"][:2]


def test_a_reopened_store_reads_only_what_is_hit(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(history, "RANGE", 10)
    items = spark.createDataFrame(story_items(), "item_seq long, batch_no int, item_id string, title string, content string, lang string, url string").fillna({"batch_no": 0})
    none, path = spark.createDataFrame([], "item_seq long"), str(tmp_path / "store")
    history.History(spark, path).add(items.where("item_seq < 30"), none)
    late = items.where("item_seq in (100, 103, 104)")  # versions of item 3 and a fresh text: range 0 is hit, 1 and 2 are not
    for n in (1, 2):
        shutil.rmtree(f"{path}/profiles/0/range={n}")
    store = history.History(spark, path)
    assert len(store.parts) == 1
    store.add(late, none)
    assert rows(history.stories(history.History(spark, path).links())) == [(100, 3), (103, 3)]


def test_bloom_filter_loses_nothing():
    keys = np.random.default_rng(3).integers(-(2**62), 2**62, 5000)
    f = history._Filter.sized(len(keys))
    f.add(keys)
    assert f.has(keys).all() and f.has(keys + 1).mean() < 0.05


# p2


def site_pages(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(3, 9)))
    sentence = lambda: " ".join([word().title(), *(word() for _ in range(rng.randrange(9, 16)))]) + "."
    pages, truth = [], {}
    for i in range(n):
        site = rng.choice(("northpost", "harbourline", "valleydaily"))
        lines = [("Home | World | Sport | Weather", 1), (f"{site.title()} uses cookies to remember your choices on this page.", 1)]
        lines += [(sentence(), 0) for _ in range(rng.randrange(3, 6))] + [("What comes next", 0), (sentence(), 0), ("", None)]
        lines += [("More stories", 1)] + [(" ".join(word() for _ in range(9)).capitalize(), 1) for _ in range(3)] + [(f"© 20{rng.randrange(10, 30)} {site.title()}. All rights reserved.", 1)]
        pages.append((i, " ".join(word() for _ in range(6)), site + "_news", f"www.{site}.example", "\n".join(x for x, _ in lines), None))
        truth |= {(i, k): y for k, (_, y) in enumerate(lines, 1) if y is not None}
    return pages, truth


def test_article_lines_on_held_out_pages(spark):
    pages, truth = site_pages(120, 1)
    pages += [(900, "t", None, None, None, None), (901, None, "x", None, "", "  \n \n"), (902, "t", "x", "y", "one line only", None), pages[0]]
    df = spark.createDataFrame([(*p, 1.0) for p in pages], "item_seq long, title string, source string, host string, content string, fulltext string, p double")
    got = {(r.item_seq, r.line_no): r.p > 0.5 for r in boilerplate.boilerplate_lines(df).collect()}
    assert set(got) == set(truth)
    assert sum(got[k] == bool(v) for k, v in truth.items()) >= 0.97 * len(truth)
    assert boilerplate.boilerplate_lines(df.limit(0)).count() == 0


def test_copies_of_pages_hide_no_line(spark):
    """Neither copies nor a corpus whose titles share their words make recurring lines look like one matter's."""
    pages, truth = site_pages(60, 2)
    df = spark.createDataFrame([(k * 1000 + p[0], *p[1:]) for k in range(15) for p in pages], "item_seq long, title string, source string, host string, content string, fulltext string")
    got = {(r.item_seq, r.line_no): r.p > 0.5 for r in boilerplate.boilerplate_lines(df).collect()}
    assert set(got) == {(k * 1000 + i, n) for k in range(15) for i, n in truth}
    assert sum(got[k] == bool(truth[k[0] % 1000, k[1]]) for k in got) >= 0.97 * len(got)
    titles = pd.DataFrame({"count": [1, 5000], "of": [10, 3]})
    few, many = boilerplate.expected_matters(titles, np.array([1.0, 15010.0]))
    assert abs(few - 1) < 1e-6 and abs(many - 13) < 1e-6 and 2.9 < boilerplate.expected_matters(titles, np.array([1000.0]))[0] < 4
    assert (boilerplate.expected_matters(titles.head(0), np.array([7.0])) == 1).all()


def test_lines_are_scored_to_their_end():
    prose = " ".join(f"word{chr(97 + i % 26)}" for i in range(60))
    zh = "新闻" * 200
    for a, b in ((prose + " and then it rained", prose + " subscribe now"), (zh + "今天下雨", zh + "立即订阅")):
        (*_, x), (*_, y) = boilerplate.page_lines(f"{a}\n{b}", None)
        assert len(x) > 55 and x != y
        at, line = boilerplate._grams([x, [], y])
        assert set(at[line == 0]) != set(at[line == 2]) and 1 not in line and (line == 0).sum() == 2 * len(x) + 1
        weights = np.zeros(boilerplate.DENSE + boilerplate.STATS + (1 << boilerplate.SPACE_BITS))
        weights[boilerplate.DENSE + boilerplate.STATS + np.setdiff1d(at[line == 2], at[line == 0])] = 5.0
        f = pd.DataFrame({"item_seq": [1], "title": ["t"], "source": [None], "host": [None], "content": [f"{a}\n\n{b}"], "fulltext": [None]})
        (got,) = boilerplate._rows(iter([f]), weights)
        assert got["logit"][1] > got["logit"][0] == 0.0
    assert boilerplate.shape_of("x" * 500 + " | a | b | c | d") == boilerplate.LABEL
    assert list(boilerplate._rows(iter([f.head(0)]), weights))[0].empty


def test_messages_equal_enumeration():
    rng = np.random.default_rng(5)
    p = boilerplate.Potentials(np.zeros(1), rng.dirichlet((1, 1), (3, 2)), rng.dirichlet((1, 1), 2), rng.dirichlet((1, 1), 3), 0.4)
    shapes, logits = [2, 1, 1, 0, 0, 2], list(rng.standard_normal(6))
    prior = np.log(0.4 / 0.6)
    own = [np.array([1 - q, q]) for q in 1 / (1 + np.exp(-(np.array(logits) - prior)))]
    total = np.zeros((6, 2))
    for bits in range(2**10):
        y, (b0, b1, b2, b3) = [bits >> i & 1 for i in range(6)], [bits >> i & 1 for i in range(6, 10)]
        w = p.block[2, b0] * p.child[2, b0, y[0]] * p.under[y[0], b1] * p.child[1, b1, y[1]] * p.child[1, b1, y[2]] * p.block[0, b2] * p.child[0, b2, y[3]] * p.child[0, b2, y[4]] * p.block[2, b3] * p.child[2, b3, y[5]]
        for i in range(6):
            w *= own[i][y[i]]
        for i in range(6):
            total[i, y[i]] += w
    assert np.allclose(boilerplate.marginals(shapes, logits, p), total[:, 1] / total.sum(1))
