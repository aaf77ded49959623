"""Candidates, deliveries, stories and the board of projects, on small tables."""

import pytest
from pyspark.sql import functions as F

from dispatchlake.functions import facts, tables
from dispatchlake.operators import candidates, delivery


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_token_pairs_against_all_pairs(spark):
    words = "ant bee cow dog elk fox gnu hen".split()
    sets = [[w for k, w in enumerate(words) if n * 37 % 101 >> k & 1] for n in range(40)] + [[], None]
    got = rows(candidates.token_pairs(spark.createDataFrame(list(enumerate(sets)), "k int, t array<string>"), "k", "t", 0.5))
    close = lambda a, b: bool(a and b) and (set(a) <= set(b) or set(b) <= set(a) or len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.5)
    assert got == [(i, j) for i in range(42) for j in range(i + 1, 42) if close(sets[i], sets[j])]


@pytest.mark.parametrize("nearby", [4, 16, 1024])
def test_first_close_against_all_pairs(spark, monkeypatch, nearby):
    monkeypatch.setattr(candidates, "NEARBY", nearby)
    monkeypatch.setattr(candidates, "STRIDE", 2)
    words = "ant bee cow dog elk fox gnu hen".split()
    sets = [[w for k, w in enumerate(words) if n * 37 % 101 >> k & 1] + [f"w{n % 13}"] for n in range(90)] + [["rare", "ant"], ["ape"], [], None, ["rare"], ["ape", "ape"], ["bee", "rare"]]
    close = lambda a, b: bool(a and b) and (set(a) <= set(b) or set(b) <= set(a) or len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.4)
    keys = sorted(f"k{n * 61 % 97:02}" for n in range(97))
    got = rows(candidates.first_close(spark.createDataFrame(list(zip(keys, sets)), "k string, t array<string>").repartition(5), "k", "t", 0.4, 3))
    want = {i: [j for j in range(i + 1, 97) if close(sets[i], sets[j])][:3] for i in range(97)}
    assert got == [(keys[i], keys[j], place) for i, js in want.items() for place, j in enumerate(js, 1)]
    assert candidates.first_close(spark.createDataFrame([], "k string, t array<string>"), "k", "t", 0.4, 3).count() == 0


def test_first_close_looks_no_further_than_it_must(spark, monkeypatch):
    """Rows that all are close to each other are done after the first stretch, so that no round meets on words."""
    monkeypatch.setattr(candidates, "NEARBY", 32)
    monkeypatch.setattr(candidates, "_placed", lambda pairs, top, placed=candidates._placed: placed(pairs, top) if "p" not in pairs.columns and "ta" not in pairs.columns else pytest.fail("met on words"))
    df = spark.range(3000).selectExpr("id as k", "array('orun', 'opens', 'plant', concat('n', id % 7)) as t")
    assert candidates.first_close(df, "k", "t", 0.3, 8).count() == 3000 * 8 - 36


def test_surface_candidates(spark):
    df = spark.createDataFrame([(1, "Orun opens plant", [1.0, 0.0]), (2, "Plant opens Orun", [0.0, 1.0]), (3, "Ada leaves", [0.9, 0.1]), (4, None, [0.8, 0.3]), (5, "", None)], "id int, s string, v array<double>")
    got = candidates.surface_candidates(df, "id", F.col("s"), "v", top=2)
    assert [(a, b) for a, b, _, _ in rows(got)] == [(1, 2), (1, 3), (3, 4)]
    assert rows(candidates.surface_candidates(df, "id", F.col("s"), "v", top=2, most=1).select("a", "b")) == [(1, 2)]
    assert candidates.surface_candidates(df.limit(0), "id", F.col("s"), "v").count() == 0


def test_hot_representatives_and_stories(spark):
    df = spark.createDataFrame([(1, 5, [1.0, 0.0]), (2, 5, [0.99, 0.1]), (3, 4, [0.0, 1.0]), (4, 1, [0.7, 0.7]), (5, 3, [0.1, 0.99])], "id bigint, heat int, v array<double>")
    assert rows(candidates.hot_representatives(df, "id", "heat", "v", 0.9, 2, 5)) == [(1, 1), (3, 2)]
    asks = spark.createDataFrame([(1, "Orun port", [1.0, 0.0]), (2, None, [0.0, 1.0]), (3, "", None)], "ask_id int, subject string, vec array<double>")
    stories = spark.createDataFrame([(7, "Port of Orun", [0.0, 1.0]), (8, "Ada", [0.1, 0.9]), (9, None, [1.0, 0.0])], "story_id int, subject string, vec array<double>")
    assert rows(candidates.candidate_stories(asks, stories)) == [(1, 7, "words")]
    assert rows(candidates.candidate_stories(asks, stories, semantic=0.8, top=1)) == [(1, 7, "words"), (1, 9, "vector"), (2, 7, "vector")]


def test_project_board(spark):
    pool = [("a", "https://github.com/orun/Hermes-agent", 900, "2026-03-01T00:00:00Z"), ("b", "https://github.com/kel/hermes", 800, None), ("c", "https://github.com/x/tools", 50, "2026-03-09T12:00:00Z"), ("d", "https://github.com/orun/delta", 70, "2026-01-01T00:00:00Z"),
            ("e", "https://github.com/shown/repo", 999, "2026-03-01T00:00:00Z"), ("f", "https://example.org/no/repo", 5, None), ("g", "https://github.com/orun/delta", 60, None), ("h", "https://github.com/vel/omnigent", 10, "bad")]
    df = spark.createDataFrame(pool, "item_id string, url string, stars bigint, created_at string")
    shown, words = spark.createDataFrame([("shown/repo",)], "project string"), spark.createDataFrame([("omnigent",), ("vel",), (None,)], "word string")
    shots = spark.createDataFrame([("d", 30, "2026-03-08T00:00:00Z"), ("d", 1, "2026-03-01T00:00:00Z"), ("a", None, None)], "item_id string, stars bigint, observed_at string").withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    got = delivery.project_board(df, shown, words, shots, F.lit("2026-03-10T00:00:00Z").cast("timestamp"))
    assert [(r.project, r.velocity) for r in got.orderBy("place").collect()] == [("orun/hermes-agent", 100.0), ("x/tools", 50.0), ("orun/delta", 20.0)]
    assert delivery.project_board(df.limit(0), shown, words, shots, F.current_timestamp()).count() == 0


def test_deliveries(spark):
    ledger = spark.createDataFrame([("r1", "web", "sent"), ("r2", "web", "failed")], "run string, channel string, status string")
    new = spark.createDataFrame([("r1", "web"), ("r2", "web"), ("r3", "post"), ("r3", "none"), ("r3", "bad")], "run string, channel string")

    def broken(row):
        raise OSError

    told = delivery.deliver(new, ledger, ["run", "channel"], {"web": lambda r: "sent", "post": lambda r: "sent", "bad": broken})
    assert sorted((t["run"], t["channel"], t["status"]) for t in told) == [("r2", "web", "sent"), ("r3", "bad", "failed"), ("r3", "none", "skipped"), ("r3", "post", "sent")]
    after = delivery.record_deliveries(ledger, new.withColumn("status", F.lit("sent")), ["run", "channel"])
    assert rows(after.where("run = 'r2'")) == [("r2", "web", "failed")] and after.count() == 5


def test_replies(spark):
    said = [('```json\n{"enough": true, "answer": " yes ", "used": [1, 2]}\n```', "yes"), ('{"enough": true, "answer": "yes", "used": [3]}', ""), ('{"enough": 1}', ""), ("", ""), (None, ""), ('{"enough": true, "answer": "a", "used": []}', ""), ("[1]", "")]
    df = spark.createDataFrame(said, "reply string, want string")
    assert all(r.got == r.want for r in df.select("want", facts.validated_reply(F.col("reply"), F.lit(2))["answer"].alias("got")).collect())
    n = facts.numbered(spark.createDataFrame([(i * 7 % 50,) for i in range(50)], "k int"), ["k"]).select("k", "token").collect()
    assert sorted((r.k, r.token) for r in n) == [(i, f"F{i + 1}") for i in range(50)]


def test_scratch_is_removed(spark):
    s = tables.Scratch(spark)
    out = s.end(s.keep(spark.range(5)).where("id > 2"))
    fs, at = tables.file_system(spark, s.path)
    assert rows(out) == [(3,), (4,)] and not fs.exists(at)
    with pytest.raises(Exception):
        tables.table(spark, "/nowhere", "none").count()


def test_diverse_fold_goes_on_until_full(spark):
    from dispatchlake.operators import selection

    data = [(g, i, 1000 - i, ["hot"] if i < 40 else [f"n{i * 7 % 23}", f"m{i % 11}"]) for g in "ab" for i in range(90)] + [("c", 1, 5, []), ("c", 2, 5, None)]
    df = spark.createDataFrame(data, "g string, id bigint, score bigint, names array<string>")
    want = set()
    for g in "abc":
        kept, seen = [], set()
        for _, i, _, names in sorted((r for r in data if r[0] == g), key=lambda r: (-r[2], r[1])):
            if len(kept) < 6 and not seen & set(names or ()):
                kept.append(i)
                seen |= set(names or ())
        want |= {(g, i, n + 1) for n, i in enumerate(kept)}
    assert set(rows(selection.diverse_fold(df, "g", "id", "score", "names", 6, 10))) == want
    assert selection.diverse_fold(df.limit(0), "g", "id", "score", "names", 6).count() == 0


def test_judges(spark):
    from dispatchlake.operators import selection

    def verdict(t):
        if t == "bad":
            raise ValueError
        if t == "broke":
            raise selection.PermanentError("402")
        return "y" in t

    df = spark.createDataFrame([(1, "yes"), (2, "no"), (3, "bad"), (4, "yes"), (5, None)], "id int, t string")
    told = selection.judge(df, "id", "t", verdict)
    assert rows(told.select("id", "vote", "clean")) == [(1, True, True), (2, False, True), (3, None, False), (4, True, True), (5, False, True)]
    assert selection.cacheable(told).count() == 3
    with pytest.raises(Exception, match="PermanentError"):
        selection.judge(spark.createDataFrame([(1, "broke")], "id int, t string"), "id", "t", verdict).collect()
    pairs = spark.createDataFrame([(1, 2, 1), (1, 3, 2), (2, 3, 1)], "a int, b int, place int")
    texts = spark.createDataFrame([(1, "boat"), (2, "boat"), (3, "car")], "id int, text string")
    assert rows(selection.same_pairs(pairs, texts, lambda a, b: a == b)) == [(1, 2)]
    assert rows(selection.same_pairs(pairs, texts, lambda a, b: True, budget=2)) == [(1, 2), (1, 3)]


def test_permanent_errors_end_runs(tmp_path):
    from dispatchlake.operators.selection import PermanentError
    from dispatchlake.plans.pipeline import Stage, StateFile, run_stages

    def fails(context):
        raise PermanentError("no payment")

    states = StateFile(str(tmp_path))
    with pytest.raises(PermanentError):
        run_stages([Stage("a", fails, optional=True)], states, "daily_20260101", {}, alert=lambda m: None)
    assert states.read("daily_20260101").status == "failed"
