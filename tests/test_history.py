import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sitequarry.operators import history
from sitequarry.operators.skew import attach, neighbour
from sitequarry.operators.snapshots import snapshot_changes

SNAP = "snapshot_id string, site_id string, created_at timestamp, loaded_at timestamp, pages array<struct<url:string,title:string,description:string,content_hash:string>>, extra string"
T = datetime(2026, 1, 1)


def snap(name, day, pages, site="s", loaded=0):
    return (name, site, T + timedelta(days=day) if day is not None else None, T + timedelta(days=loaded), None if pages is None else [(p[0], p[1], p[2], p[3]) for p in pages], "x")


def changes(spark, rows):
    return sorted((r.snapshot_id, r.url, r.change_type, r.detail) for r in snapshot_changes(spark.createDataFrame(rows, SNAP)).collect())


A, B, C = ("u/a", "A", "da", "h1"), ("u/b", "B", "db", "h2"), ("u/c", "C", "dc", None)


def test_added_removed_changed(spark):
    got = changes(spark, [snap("1", 0, [A, B, C]), snap("2", 40, [("u/a", "A2", "da", "H9"), C, ("u/d", "D", "", "h")]), snap("3", 80, [("u/a", "A2", "d2", "h9"), ("u/c", "C", "new", "h"), ("u/d", "D", "", "H")])])
    assert got == [("2", "u/a", "changed", 'Title: "A" → "A2"'), ("2", "u/b", "removed", None), ("2", "u/d", "added", None), ("3", "u/c", "changed", "Description updated")]


def test_deliveries_duplicates_and_nulls(spark):
    rows = [
        snap("1", 0, [A]), snap("2", 1, [A], loaded=1), snap("2", 1, [A, B], loaded=2), snap("bad", 2, None, loaded=3), snap("empty", 3, []), snap("4", 4, [A, ("u/a", "A", "x", "zz"), (None, "n", "", "h"), ("u/b", None, None, None)]), snap("4", 4, None, loaded=-1),
        snap("none", None, [A]), (None, "s", T, T, [], "x"), snap("other", 9, [B], site="t"),
    ]
    got = changes(spark, rows)
    assert got == [("2", "u/b", "added", None), ("4", "u/a", "added", None), ("4", "u/b", "added", None), ("empty", "u/a", "removed", None), ("empty", "u/b", "removed", None)]


def test_equal_snapshots_and_empty_tables(spark):
    assert changes(spark, [snap("1", 0, [A, B]), snap("2", 0, [B, A])]) == [], "ties follow the snapshot_id; order within doesn't matter"
    assert changes(spark, []) == []


def test_many_pages_against_a_plain_diff(spark):
    rng = random.Random(4)
    state, rows, want = {}, [], set()
    for day in range(6):
        before = dict(state)
        for _ in range(60):
            u = f"u/{rng.randrange(300)}"
            if rng.random() < 0.3:
                state.pop(u, None)
            else:
                state[u] = rng.choice(["h1", "h2", "H1", None]), rng.choice(["t", "v"])
        pages = [(u, t, "d", h) for u, (h, t) in state.items()]
        rng.shuffle(pages)
        rows.append(snap(f"n{day}", day * 20, pages))
        if day:
            for u in {*before, *state}:
                if u not in before or u not in state:
                    want.add((f"n{day}", u, "added" if u in state else "removed"))
                else:
                    (h0, t0), (h1, t1) = before[u], state[u]
                    if (h0.lower() != h1.lower()) if h0 and h1 else t0 != t1:
                        want.add((f"n{day}", u, "changed"))
    assert {r[:3] for r in changes(spark, rows)} == want


def test_hashes_and_text_diffs(spark):
    rows = spark.createDataFrame([snap("1", 0, [A, B]), snap("2", 1, [B, A]), snap("3", 2, [A, ("u/b", "B", "db", "zz")]), snap("4", 3, [])], SNAP)
    h = {r[0]: r[1] for r in rows.select("snapshot_id", history.snapshot_hash(F.col("pages"))).collect()}
    assert h["1"] == h["2"] != h["3"] and all(len(x) == 16 for x in h.values())
    pairs = spark.createDataFrame([(1, "a\n b \nb\n\nc", "c\nd\nd\na"), (2, None, "x"), (3, "same", "same")], "id int, old string, new string")
    got = sorted((r.id, r.change, r.no, r.line) for r in history.diff_text(pairs, "id", "old", "new").collect())
    assert got == [(1, "added", 1, "d"), (1, "removed", 1, "b"), (2, "added", 1, "x")]


def test_retention_and_sites(spark):
    rows = spark.createDataFrame([("s", i, i % 3) for i in range(6)] + [("t", 9, 0)], "site_id string, id int, at int")
    assert sorted((r.site_id, r.id, r["rank"]) for r in history.newest(rows, ["site_id"], ["at", "id"], 2).collect()) == [("s", 2, 2), ("s", 5, 1), ("t", 9, 1)]
    assert [r.id for r in history.newest_overall(rows, ["at", "id"], 1).collect()] == [5]
    cols = "site_id string, url string, site_name string, monitoring boolean, created_at timestamp, last_checked_at timestamp"
    sites = spark.createDataFrame([("1", "u1", "one", True, T, None), ("2", "u2", "two", False, T, T), ("3", "u3", "three", True, T, T)], cols)
    new = spark.createDataFrame([("9", "u1", "uno", False, None, T), ("8", "u8", "eight", False, T, None)], cols)
    got = {r.url: (r.site_id, r.site_name, r.monitoring) for r in history.upsert_sites(sites, new).collect()}
    assert got == {"u1": ("1", "uno", True), "u2": ("2", "two", False), "u3": ("3", "three", True), "u8": ("8", "eight", False)}
    assert [r.site_id for r in history.due_sites(sites).collect()] == ["1", "3"]
    left, snaps = history.delete_sites(sites, spark.createDataFrame([("1", "a"), ("2", "b")], "site_id string, snapshot_id string"), spark.createDataFrame([("1",)], "site_id string"))
    assert left.count() == 2 and [r.snapshot_id for r in snaps.collect()] == ["b"]
    checked = history.mark_checked(sites, spark.createDataFrame([("1", T), ("3", T - timedelta(days=1))], "site_id string, checked_at timestamp"))
    assert {r.site_id: r.last_checked_at for r in checked.collect()} == {"1": T, "2": T, "3": T}


def test_rebuilt_snapshots(spark):
    rows = spark.createDataFrame([snap("1", 0, [A]), snap("2", 1, [A]), snap("3", 2, [B])], SNAP)
    got = {r.snapshot_id: (r.added, r.removed, r.changed_pages, r.changed) for r in history.rebuilt_snapshots(rows).collect()}
    assert got == {"1": (0, 0, 0, True), "2": (0, 0, 0, False), "3": (1, 1, 0, True)}


def test_neighbours_cross_buckets(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else f"g{rng.randrange(5)}", rng.randrange(400), i) for i in range(600)]
    frame = spark.createDataFrame(rows, "g string, at int, id int")
    got = {r.id: r.prev_id for r in neighbour(frame, ["g"], ["at", "id"], F.floor(F.col("at") / 25).cast("int"), ["id"]).collect()}
    for g in {r[0] for r in rows}:
        order = sorted((at, i) for h, at, i in rows if h == g)
        for before, after in zip([None, *order], order, strict=False):
            assert got[after[1]] == (before[1] if before else None)


def test_hot_keys_are_joined_whole(spark):
    facts = spark.createDataFrame([("hot" if i % 3 == 0 else f"k{i % 50}" if i % 3 == 1 else None, i) for i in range(3000)], "key string, id int")
    lookup = facts.groupBy("key").agg(F.count("*").alias("rows"), F.min("id").alias("first"))
    got = attach(facts, lookup, ["key"], "rows", 3000)
    assert got.count() == 3000 and got.columns == ["key", "id", "rows", "first"]
    assert got.where("key = 'hot'").count() == 1000 and got.where("key IS NULL").select("first").distinct().count() == 1
