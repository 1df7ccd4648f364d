"""Ledger semantics: order inside a session, closed entries, scope, tools, hot keys."""

from pyspark.sql import functions as F

from findlake.operators import accept, ledger as L, lifecycle, ordered
from findlake.schemas import FLAT_FINDING, LEDGER, MEMORY

AT = "2024-01-01"

ANCHORS = [
    ("cobra.go", "4040bc5054d8ace8"), ("command.go", "929ffe6929d1850a"), ("command.go", "4ca8a8bdbc663a18"), ("flag_groups.go", "784cb6c31e0820bd"),
    ("flag_groups.go", "3538d3e3d96d3cd3"), ("flag_groups.go", "c0917b1f1477404a"), ("flag_groups.go", "3538d3e3d96d3cd3"),
    ("flag_groups.go", "67d80a8c9c80eaf6"), ("flag_groups.go", "3538d3e3d96d3cd3"),
]


def found(spark, items, start=0):
    data = [("r", f, rule, cat, "medium", 1, anchor, start + i, "t") for i, (f, rule, cat, anchor) in enumerate(items)]
    return spark.createDataFrame(data, FLAT_FINDING)


def empty(spark):
    return spark.createDataFrame([], LEDGER)


def tally(result):
    counts = {r["outcome"]: r["n"] for r in result.report.groupBy("outcome").agg(F.count("*").alias("n")).collect()}
    return [counts.get(k, 0) for k in ("new", "unchanged", "changed", "auto_resolved", "reopened")]


def kept(spark, df):
    """Rows of a small result as a new table, so steps do not pile up in one plan."""
    return spark.createDataFrame(df.collect(), LEDGER)


def test_replay_of_a_pinned_repository(spark):
    every = [(f, "no-panic", "architecture", a) for f, a in ANCHORS]
    first = L.sync(found(spark, every), empty(spark), "s1", AT)
    assert tally(first) == [3, 0, 6, 0, 0]
    state = kept(spark, first.ledger)
    second = [(f, r, c, a + "x" if i % 7 == 3 else a) for i, (f, r, c, a) in enumerate(every) if i % 5]
    again = L.sync(found(spark, second, 100), state, "s2", AT)
    assert tally(again) == [0, 1, 6, 1, 0]
    state = kept(spark, again.ledger)
    opened = state.where("status = 'open'").orderBy("entry_ord").first()["entry_id"]
    state = kept(spark, state.withColumn("status", F.when(F.col("entry_id") == opened, "dismissed").otherwise(F.col("status"))))
    back = L.sync(found(spark, every, 200), state, "s3", AT)
    assert tally(back) == [0, 0, 7, 0, 2]
    state = kept(spark, back.ledger)
    scope = spark.createDataFrame([("r", "cobra.go")], "repo string, file string")
    gone = L.sync(found(spark, [], 300), state, "s4", AT, scope=scope)
    assert tally(gone) == [0, 0, 0, 1, 0]
    assert gone.ledger.count() == 3


def test_category_identifies_a_finding_without_a_rule(spark):
    result = L.sync(found(spark, [("a", None, "x", "1"), ("a", None, "y", "1"), ("a", "x", "x", "1")]), empty(spark), "s1", AT)
    assert tally(result) == [3, 0, 0, 0, 0]


def test_missing_anchor_is_never_a_change(spark):
    result = L.sync(found(spark, [("a", "r", "c", "1"), ("a", "r", "c", None), ("a", "r", "c", "2")]), empty(spark), "s1", AT)
    assert tally(result) == [1, 2, 0, 0, 0]


def test_entries_of_tools_that_did_not_run_stay(spark):
    state = kept(spark, L.sync(found(spark, [("a", "eslint:x", "c", "1"), ("b", "semantic:y", "c", "1"), ("c", "plain", "c", "1")]), empty(spark), "s1", AT).ledger)
    ran = spark.createDataFrame([("r", "ruff")], "repo string, tool string")
    result = L.sync(found(spark, [], 50), state, "s2", AT, ran_tools=ran, known_tools=["eslint", "ruff"])
    assert {r["rule_id"]: r["status"] for r in result.ledger.collect()} == {"eslint:x": "open", "semantic:y": "open", "plain": "resolved"}


def test_history_is_appended_once_per_move(spark):
    state = kept(spark, L.sync(found(spark, [("a", "r", "c", "1")]), empty(spark), "s1", AT).ledger)
    state = kept(spark, L.sync(found(spark, []), state, "s2", AT).ledger)
    state = kept(spark, L.sync(found(spark, [("a", "r", "c", "1"), ("a", "r", "c", "2")], 9), state, "s3", AT).ledger)
    entry = state.first()
    assert entry["status"] == "reopened" and entry["anchor"] == "2"
    assert [h["new_state"] for h in entry["history"]] == ["open", "resolved", "reopened"]


def test_repositories_without_a_session_are_left_alone(spark):
    two = spark.createDataFrame([("p", "a", "r", "c", "low", 1, "1", 1, "t"), ("q", "a", "r", "c", "low", 1, "1", 2, "t")], FLAT_FINDING)
    state = kept(spark, L.sync(two, empty(spark), "s1", AT).ledger)
    session = spark.createDataFrame([("p", "s2", None)], "repo string, session string, at timestamp")
    result = L.sync(two.limit(0), state, session)
    assert {r["repo"]: r["status"] for r in result.ledger.collect()} == {"p": "resolved", "q": "open"}


def test_baseline_matches_one_for_one(spark):
    base = accept.create_baseline(found(spark, [("a", "r", "c", "1")] * 2 + [("b", None, "c", None)]))
    assert {(r["key"], r["count"]) for r in base.collect()} == {("a::r::1", 2), ("b::::", 1)}
    split = accept.apply_baseline(found(spark, [("a", "r", "c", "1")] * 3 + [("a", "r", "c", "2")]), base)
    assert [r["baselined"] for r in split.orderBy("ord").collect()] == [True, True, False, False]


def test_memory_precedence_and_wildcards(spark):
    items = [
        ("r", "m1", "exception", None, None, None, "active", 1, ""), ("r", "m2", "suppression", "a", "x", "c", "active", 2, ""),
        ("r", "m3", "accepted-deviation", None, "x", None, "active", 3, ""), ("r", "m4", "suppression", "b", None, "c", "active", 4, ""),
        ("r", "m5", "suppression", "z", "x", "c", "archived", 0, ""),
    ]
    out = accept.apply_memory(found(spark, [("a", "x", "c", "1"), ("b", "x", "c", "1"), ("b", None, "c", "1"), ("z", None, "q", "1")]), spark.createDataFrame(items, MEMORY))
    assert [r["memory_item"] for r in out.orderBy("ord").collect()] == ["m2", "m3", "m4", "m1"]


def test_chunked_order_equals_a_plain_window(spark):
    from pyspark.sql import Window

    data = spark.range(3000).select(F.lit("r").alias("repo"), F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 17)).alias("k"), F.col("id").alias("ord"), F.when(F.col("id") % 5 > 0, F.col("id") % 7).alias("v"))
    plain = Window.partitionBy("repo", "k").orderBy("ord")
    want = {(r[0]): (r[1], r[2]) for r in data.select("ord", F.row_number().over(plain), F.lag("v").over(plain)).collect()}
    got = {r["ord"]: r["nth"] for r in ordered.numbered(data, ["repo", "k"], "ord", width=64).collect()}
    back = {r["ord"]: r["previous"] for r in ordered.with_previous(data, ["repo", "k"], "ord", "v", width=64).collect()}
    assert got == {o: n for o, (n, _) in want.items()}
    assert {o: (p["value"] if p else None) for o, p in back.items()} == {o: v for o, (_, v) in want.items()}
    assert sum(p is None for p in back.values()) == data.select("k").distinct().count()


def walk(states, moves, requests):
    at, out = states[0], []
    for target in requests:
        legal = target in moves[at]
        out.append((at, legal, target if legal else at))
        at = out[-1][2]
    return out


def test_lifecycle_fold_over_several_block_levels(spark, monkeypatch):
    monkeypatch.setattr(lifecycle, "BLOCK", 4)
    for states, moves in (lifecycle.LEDGER, lifecycle.MEMORY, lifecycle.SESSION):
        requests = {k: [states[(i * i + 3 * i + len(k)) % len(states)] for i in range(n)] for k, n in (("a", 70), ("bb", 5), ("ccc", 1))}
        data = [(k, i, s) for k, items in requests.items() for i, s in enumerate(items)]
        df = spark.createDataFrame(data, "k string, ord long, target string")
        out = lifecycle.fold(df, ["k"], "ord", "target", (states, moves))
        for k, items in requests.items():
            got = [(r["state_before"], r["accepted"], r["state_after"]) for r in out.where(F.col("k") == k).orderBy("ord").collect()]
            assert got == walk(states, moves, items)


def test_page_and_listing(spark):
    state = L.sync(found(spark, [(f"f{i}", "r", "c", "1") for i in range(7)]), empty(spark), "s1", AT).ledger
    page = L.page(state, after=1, limit=3).orderBy("position").collect()
    assert [r["file"] for r in page] == ["f2", "f3", "f4"] and page[0]["total"] == 7 and page[-1]["next_cursor"] == 4
    assert L.listing(state, status=["resolved"]).count() == 0 and L.listing(state, file="f3").count() == 1
