import random

import pytest
from pyspark.sql import functions as F

from dispatchlake.functions import facts, ids, moments, numbers, text, vec
from dispatchlake.operators import relational, selection, similarity, stories
from dispatchlake.sources import feeds, fetching


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("url", "want"), [("HTTP://Ex.com:80/a/?b=2&a=1&utm_x=3#f", "http://ex.com/a?a=1&b=2"), ("https://ex.com/", "https://ex.com/"), ("https://u:p@EX.com:8443//a//?x", "https://ex.com:8443//a?x="), (None, ""), ("http://e.x/?a=%20b+c&a=*~é", "http://e.x/?a=+b+c&a=%2A~%C3%A9")])
def test_normalized_url(spark, url, want):
    assert one(spark, ids.normalized_url(F.lit(url).cast("string"))) == want


def test_numbers(spark):
    assert one(spark, numbers.bare_numbers(F.lit("A 1,200 b3 {F4} 50% 7."))) == ["1,200", "50%", "7."]
    assert one(spark, numbers.unsourced_numbers(F.lit("1,200 and 50% and 9"), F.lit("1200 or 50"))) == ["50%", "9"]
    assert one(spark, numbers.scrub_numbers(F.lit("9 of 10"), F.lit("10"))) == "[待核实] of 10"
    assert one(spark, numbers.render_tokens(F.lit("{F1}/{ F2 }"), F.create_map(F.lit("F1"), F.lit("7")))) == "7/[待核实]"
    assert one(spark, numbers.scrub_markup(F.lit("a {b} F2S26 }"))) == "a b [待核实] "
    assert one(spark, numbers.risky_claims(F.lit("公司申请上市，估值翻倍"))) == ["上市/融资:申请上市", "上市/融资:估值", "倍数话术:翻倍"]


def test_text(spark):
    assert one(spark, text.clean_text(F.lit("<p>a &amp; b</p>  https://x.y/z c"))) == "a & b c"
    assert one(spark, text.clean_text(F.lit(None).cast("string"))) == ""
    assert one(spark, text.body_beyond_title(F.lit("<a>Big News</a> extra"), F.lit("big news"))) == 5
    assert one(spark, text.source_family(F.lit(" X-Google-News-fr "))) == "google-news"
    assert one(spark, text.salient_entities(F.lit("The Orun said Orun and velar"))) == ["orun"]
    assert one(spark, text.subject_closeness(F.lit("Orun port"), F.lit("《Orun》 port 罢工"))) == 1.0
    assert one(spark, text.repo_key(F.lit("https://github.com/Own/Repo/tree"))) == "own/repo"
    assert one(spark, text.name_tokens(F.lit("own/hermes-agent"))) == ["hermes"]


def test_vectors_and_times(spark):
    v = lambda *x: F.array(*[F.lit(float(y)) for y in x])
    assert one(spark, vec.cosine(v(1, 0), v(1, 1))) == pytest.approx(0.7071068)
    assert one(spark, vec.cosine(v(0, 0), v(1, 1))) == 0.0
    assert one(spark, vec.cosine(v(1), v(1, 1))) is None
    at, now = F.lit("2026-01-01").cast("timestamp"), F.lit("2026-01-02").cast("timestamp")
    assert one(spark, moments.age_hours(at, now)) == 24
    assert one(spark, moments.fresh_or_undated(F.lit(None).cast("timestamp"), now, F.lit(1)))
    assert not one(spark, moments.fresh_and_dated(F.lit(None).cast("timestamp"), now, F.lit(1)))
    assert one(spark, moments.logical_date(F.lit("manual_20260105"), now, "UTC")) == "2026-01-05"


def test_facts(spark):
    assert one(spark, facts.merged(F.lit('{"a":1,"b":{"c":2}}'), F.lit('{"a":3}'))) == {"a": "3", "b": '{"c":2}'}
    assert one(spark, facts.merged(F.lit("[1]"), F.lit('{"a":3}'))) == {"a": "3"}
    assert [x["kind"] for x in one(spark, facts.extract_facts(F.lit("i"), F.lit('{"hn":{"points":0}}')))] == ["hn.points"]


def test_writes(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "k int, v string, w string")
    new = spark.createDataFrame([(2, None, "y"), (3, "c", None), (None, "d", None)], "k int, v string, w string")
    got = {tuple(r) for r in relational.upsert(old, new, ["k"], replace=["v"], if_given=["w"]).collect()}
    assert got == {(1, "a", "x"), (2, None, "y"), (3, "c", None), (None, "d", None)}
    assert {r.k for r in relational.insert_absent(old, new, ["k"]).collect()} == {1, 2, 3, None}
    none = new.limit(0)
    assert relational.prune(old, none, F.lit(True), ["k"]).count() == 0
    marked = old.withColumn("pruned_at", F.lit(None).cast("string"))
    assert relational.soft_prune(marked, none, F.lit(True), ["k"], F.lit("now")).where("pruned_at is not null").count() == 0
    assert relational.soft_prune(marked, new, F.lit(True), ["k"], F.lit("now")).where("pruned_at is not null").select("k").first()[0] == 1


def test_quota_fold_against_a_loop(spark):
    rng = random.Random(5)
    rows = [(g, i, rng.randrange(6), rng.choice("abc"), rng.choice("uvwx"), rng.random() < 0.3) for g in "pqrs" for i in range(60)]
    df = spark.createDataFrame(rows, "board string, id int, score int, cat string, src string, old boolean")
    got = {(r.board, r.id, r["rank"]) for r in selection.quota_fold(df, "board", "id", "score", {"cat": 4, "src": 3}, 9, {"old": 2}).collect()}
    want = set()
    for g in "pqrs":
        kept = []
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1])):
            if len(kept) < 9 and sum(k[3] == r[3] for k in kept) < 4 and sum(k[4] == r[4] for k in kept) < 3 and (not r[5] or sum(k[5] for k in kept) < 2):
                kept.append(r)
        want |= {(g, r[1], n) for n, r in enumerate(kept, 1)}
    assert got == want


def test_gate_directions(spark):
    df = spark.createDataFrame([("b", i, 10 - i) for i in range(5)], "g string, id int, score int")
    votes = spark.createDataFrame([(0, False), (1, True), (2, None)], "id int, vote boolean")
    kept = lambda **k: [r.kept for r in selection.through_gate(df, votes, selection.Gate(votes=1, **k), "g", "id", "score").orderBy("id").collect()]
    assert kept() == [False, True, True, True, True]
    assert kept(on_error=False, tail=False, head=3) == [False, True, False, False, False]
    assert kept(budget=1, on_budget=False) == [False] * 5
    told = selection.judge(df.withColumn("t", F.lit("x").cast("string")), "id", "t", lambda t: 1 / 0)
    assert told.where("vote is null and not clean").count() == 5


def test_components_and_leaders(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (9, 9), (3, 1)], "a long, b long")
    assert {tuple(r) for r in similarity.components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)}
    items = spark.createDataFrame([(1, 10, "a"), (2, 20, "b"), (3, 30, "a"), (4, None, "c")], "id long, t long, fp string").withColumn("at", F.timestamp_micros("t"))
    pairs = spark.createDataFrame([(1, 2, 0.9), (2, 4, 0.95), (3, 4, 0.95)], "a long, b long, cosine double")
    got = {tuple(r) for r in similarity.leader_parents(items, pairs, "id", "at", "fp").collect()}
    assert got == {(3, 1, "fingerprint"), (2, 1, "vector"), (4, 2, "vector")}


def test_pairs_in_a_window(spark):
    rows = [(i, [1.0, i / 100], float(i)) for i in range(30)] + [(99, [0.0, 0.0], 1.0), (98, None, 1.0)]
    df = spark.createDataFrame(rows, "id long, v array<double>, t double")
    got = {(r.a, r.b) for r in similarity.pairs_at_least(df, "id", "v", 0.5, ("t", 4.0)).collect()}
    assert got == {(a, b) for a in range(30) for b in range(a + 1, 30) if b - a <= 4}


def test_stories(spark):
    df = spark.createDataFrame([("d", 1, "alpha beta"), ("d", 2, "alpha beta gamma"), ("d", 3, "delta"), ("d", 4, None)], "domain string, id int, subject string")
    got = {(r.id, r.thread, r.is_new) for r in stories.assign_to_stories(df, "domain", [], "id", "subject").collect()}
    assert got == {(1, "thr_1", True), (2, "thr_1", False), (3, "thr_3", True), (4, "thr_4", True)}


def test_feeds(spark):
    feed = "<rss><channel><item><title>T</title><link>https://a.b/c</link><pubDate>x</pubDate><description>short</description></item><item><title></title><link>https://a.b/d</link></item><item><title>G</title><guid>https://a.b/g</guid></item></channel></rss>"
    got = feeds.rss(spark.createDataFrame([("s", feed), ("h", "<!doctype html><html><p></html>"), ("n", None)], "source string, body string")).collect()
    assert [(r.url, r.title, r.content) for r in got if r.error is None] == [("https://a.b/c", "T", "short"), ("https://a.b/g", "G", "")]
    assert {r.source for r in got if r.error} == {"h", "n"}
    hn = feeds.hackernews(spark.createDataFrame([("s", '{"hits":[{"objectID":"5","story_title":"S","points":3,"created_at":"2026-01-01T00:00:00Z"}]}'), ("e", "[]")], "source string, body string")).collect()
    assert [r.url for r in hn if r.error is None] == ["https://news.ycombinator.com/item?id=5"] and [r.source for r in hn if r.error] == ["e"]
    with pytest.raises(NotImplementedError):
        feeds.parser("reddit")


def test_polling(spark):
    calls = []

    def fetch(url, etag, modified):
        return (304, None, None, None) if etag else (200, "body", "e1", None)

    asks = spark.createDataFrame([("a", "https://x.org/f", None, None), ("b", "https://x.org/g", "e", None), ("c", "http://127.0.0.1/", None, None), ("d", "file:///etc", None, None)], "source string, url string, etag string, last_modified string")
    got = {r.source: r for r in fetching.poll(asks, fetch).collect()}
    assert got["a"].body == "body" and got["b"].not_modified and got["c"].error == "refused: inside address" and got["d"].error == "refused: scheme" and not calls


def test_runs_resume(tmp_path):
    from dispatchlake.plans import pipeline

    seen, said = [], []

    def stage(name, fail=False):
        def run(context):
            seen.append(name)
            if fail and not context.get("mended"):
                raise RuntimeError("broken")
            return {"n": 1}

        return run

    stages = [pipeline.Stage("a", stage("a")), pipeline.Stage("o", stage("o", True), optional=True), pipeline.Stage("b", stage("b", True)), pipeline.Stage("c", stage("c"))]
    states = pipeline.StateFile(str(tmp_path))
    with pytest.raises(RuntimeError):
        pipeline.run_stages(stages, states, "daily_20260101", {}, alert=said.append)
    assert states.read("daily_20260101").status == "failed" and len(said) == 2
    assert pipeline.run_stages(stages, states, "daily_20260101", {"mended": True}, alert=said.append).status == "succeeded"
    assert seen == ["a", "o", "b", "b", "c"]
    pipeline.run_stages(stages, states, "daily_20260101", {})
    assert seen == ["a", "o", "b", "b", "c"]


def test_archive(spark, tmp_path):
    from dispatchlake.operators import archive

    rows = spark.createDataFrame([("2026-01-01", "x", "u", 1), ("2026-01-01", "x", "u", 2), ("2026-01-01", "x", "", 3), ("2026-01-01", "x", None, 4), ("2026-01-02", "y", "v", 5)], "date string, label string, url string, id int")
    old = rows.where("date = '2026-01-02'")
    assert archive.merge_days(rows, old, "label", "url").count() == 3
    archive.write_days(rows, str(tmp_path / "days"))
    archive.write_days(old.withColumn("id", F.lit(9)), str(tmp_path / "days"))
    got = archive.read_days(spark, str(tmp_path / "days"), "label string, url string, id int, date string")
    assert got.count() == 5 and got.where("id = 9").count() == 1
    assert one(spark, archive.highlighted(F.lit("a.B a.b axb"), "A.b")) == "<mark>a.B</mark> <mark>a.b</mark> axb"


def test_scores(spark):
    from dispatchlake.functions import scores

    assert one(spark, scores.velocity(F.lit(3), F.lit(0), 2.0)) == 0.0
    assert one(spark, scores.velocity(F.lit(9), F.lit(3), 2.0)) == 2.0
    assert one(spark, scores.heat(F.lit(-1.0), F.lit(1.0))) == 0.0
    assert one(spark, scores.recency(F.lit(6.0), F.lit(24))) == 0.75
    assert one(spark, scores.recency(F.lit(None).cast("double"), F.lit(24))) == 0.0
    assert one(spark, scores.blend(F.lit(1.0), F.lit(0.5))) == pytest.approx(0.8)
    assert one(spark, scores.blend(F.lit(None).cast("double"), F.lit(0.5))) == 0.5
    assert one(spark, scores.best_key(F.create_map(F.lit("b"), F.lit(0.5), F.lit("a"), F.lit(0.5)))) == "a"
    assert one(spark, scores.relevance_gate(F.lit(0.4), F.lit(True))) and not one(spark, scores.relevance_gate(F.lit(0.4), F.lit(False)))
    assert one(spark, scores.pair_key(F.lit("x"), F.lit("y"))) == one(spark, scores.pair_key(F.lit("y"), F.lit("x")))
    assert one(spark, scores.age_label(F.lit(-3.0))) == "0h"


def test_headline_repair(spark):
    from dispatchlake.operators import coherence

    e = [[float(i == j) for j in range(4)] for i in range(4)]
    cards = spark.createDataFrame([("b", 1, e[1], e[0]), ("b", 2, e[0], e[1]), ("b", 3, e[2], e[2]), ("c", 4, e[0], e[1]), ("c", 5, None, e[1])], "batch string, id int, h array<double>, v array<double>")
    assert {tuple(r) for r in coherence.repair_headlines(cards, "batch", "id", "h", "v").collect()} == {("b", 1, 2), ("b", 2, 1)}


def test_command_line(capsys):
    from dispatchlake.plans import cli

    assert cli.main(["--list"]) == 0 and "cluster_heat" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["nothing"])
