"""Problems 5, 6, 8 and 9."""

import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitequarry.llm.ledger import address_key, address_rows, batch_counts, build_ledger, duplicates, merge
from sitequarry.llm.mixing import budgets, mix, shares, sized
from sitequarry.llm.near_duplicates import NearDuplicates, components
from sitequarry.llm.packing import best_fit, complete_bins, pack
from sitequarry.llm.tokens import wordpunct_count

T = datetime(2026, 1, 1)
PAGES = "page_id long, title string, text string, loaded_at timestamp, id long, a string"


# problem 5


def near(spark, rows, **kw):
    return NearDuplicates(spark.createDataFrame([(i, title, text, T + timedelta(days=day), 1, "x") for i, title, text, day in rows], PAGES), **kw)


def brute(rows, words, threshold, least):
    import re

    sets = {}
    for i, title, text, _ in sorted(rows, key=lambda r: r[3]):
        if i is None or text is None or len(re.findall(r"[^\W_]+", text)) < least:
            sets.pop(i, None)
            continue
        w = re.findall(r"[^\W_]+", f"{title or ''} {text}".lower())
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)}
    ids = sorted(i for i in sets if sets[i])
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


@pytest.mark.parametrize(("words", "threshold"), [(3, 0.6), (5, 0.8), (1, 0.5)])
def test_pairs_and_groups_equal_brute_force(spark, words, threshold):
    rng = random.Random(words)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        if rows and rng.random() < 0.6:
            base = list(rng.choice(rows)[2].split())
            for _ in range(rng.choice([0, 0, 1, 3, 8])):
                at = rng.randrange(len(base))
                base[at : at + rng.randrange(2)] = [rng.choice(vocabulary)] * rng.randrange(2)
        else:
            base = [rng.choice(vocabulary) for _ in range(rng.choice([12, 40, 90, 200]))]
        rows.append((i, rng.choice([None, "Title", ""]), " ".join(base) or "x", 0))
    rows += [(900, "t", None, 0), (901, "t", "", 0), (902, None, "short", 0), (None, "t", "a b c d e f g", 0), (3, rows[3][1], rows[3][2], 5)]
    n = near(spark, rows, words=words, threshold=threshold, least_words=5)
    want = brute(rows, words, threshold, 5)
    assert {tuple(r) for r in n.page_pairs().collect()} == want
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in want:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    groups = {r.page_id: (r.group_id, r.links) for r in n.groups().collect()}
    assert all(groups[p][0] == top(p) for p in groups)
    assert all(groups[p][1] == sum(p in pair for pair in want) for p in groups)


def test_a_third_of_copies_stays_one_class(spark):
    text = " ".join(f"same{i}" for i in range(60))
    rows = [(i, "t", text if i % 3 == 0 else " ".join(f"x{i}y{k}" for k in range(60)), 0) for i in range(600)]
    n = near(spark, rows)
    assert n.pairs.count() == 0 and n.members.where("class_rows = 200").count() == 200
    assert n.groups().where("links = 199").select("group_id").distinct().count() == 1
    assert near(spark, []).page_pairs().count() == 0 and near(spark, []).groups().count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(300, 301), (301, 300), (400, 400)]
    got = {r.class_id: r.group_id for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(40)} | {300: 300, 301: 300}


# problem 6


def test_addresses_that_name_one_page(spark):
    same = ["https://acme.com/a/b?x=1&y=2", "HTTPS://WWW.Acme.com:443//A/b/?y=2&x=1#top", " acme.com/%61/b?utm_source=q&x=1&y=2\n", "https://acme.com/a/b/?ref=1&y=2&x=1&", "//acme.com/a/b?y=%32&x=1"]
    other = ["http://acme.com/a/b?x=1&y=2", "https://acme.com/a/b?x=1", "https://acme.com:444/a/b?x=1&y=2", "https://acme.com/a/b/c?x=1&y=2", "https://docs.acme.com/a/b?x=1&y=2", "https://acme.com/100%?x=1", "https://acme.com/%ff", "https://acme.com/a+b", "https://acme.com/é"]
    keys = [r[0] for r in spark.createDataFrame([(u,) for u in same + other], "u string").select(address_key(F.col("u"))).collect()]
    assert len(set(keys[:5])) == 1 and len(set(keys)) == 1 + len(other)
    assert [r[0] for r in spark.createDataFrame([(None,), ("",), (" \n",)], "u string").select(address_key(F.col("u"))).collect()] == [None, None, None]
    plain, escaped = (r[0] for r in spark.createDataFrame([("https://acme.com/é",), ("https://acme.com/%C3%89",)], "u string").select(address_key(F.col("u"))).collect())
    assert plain == escaped


def test_ledger_adds_up_batch_by_batch(spark):
    rng = random.Random(6)
    crawled = [(i, f"https://acme.com/{'hot' if i % 3 == 0 else rng.randrange(60)}" + rng.choice(["", "/", "#x", "?utm_a=1"])) for i in range(400)]
    crawled += [crawled[7], (None, "https://acme.com/1"), (401, None), (402, " ")]
    extracted = [(i, f"https://acme.com/{i % 5}") for i in range(20)] + [(30, None)]
    rows = address_rows(spark.createDataFrame(crawled, "page_id long, url string"), spark.createDataFrame(extracted, "page_id long, canonical string"))
    whole = {(r.field, bytes(r.key_hash)): (r.copies, r.first_page_id) for r in batch_counts(rows).collect()}
    for batches in (1, 3, 7):
        assert {(r.field, bytes(r.key_hash)): (r.copies, r.first_page_id) for r in build_ledger(rows, batches).collect()} == whole
    groups = {}
    for i, u in sorted(set(crawled[:400])):
        groups.setdefault(u.split("#")[0].split("?")[0].rstrip("/"), []).append(i)
    want = {("url", g[0], i) for g in groups.values() for i in g[1:]} | {("canonical", i % 5, i) for i in range(5, 20)}
    assert {(r.field, r.first_page_id, r.page_id) for r in duplicates(rows, build_ledger(rows)).collect()} == want
    none = rows.where("false")
    assert build_ledger(none).count() == 0 and duplicates(none, build_ledger(none)).count() == 0
    again = merge(build_ledger(rows), batch_counts(rows).select("field", "key_hash", "bucket", "copies", "first_page_id"))
    assert {(r.field, bytes(r.key_hash)): r.copies for r in again.collect()} == {k: 2 * v[0] for k, v in whole.items()}


# problem 8


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=60))
def test_bins_hold_everything_and_never_overflow(sizes):
    for bins in (best_fit(sizes, 100), complete_bins(sizes, 100)):
        assert sorted(s for b in bins for s in b) == sorted(sizes) and all(sum(b) <= 100 for b in bins)
    assert len(complete_bins(sizes, 100)) <= len(best_fit(sizes, 100))


def test_completion_beats_best_fit():
    sizes = [40, 40, 36, 34, 30, 30, 30, 30, 30]
    assert len(best_fit(sizes, 100)) == 4 and len(complete_bins(sizes, 100)) == 3


DOCS = "doc_id long, n_tokens int, text string, source string, block string, fill string"


def test_pieces_and_containers(spark):
    rng = random.Random(8)
    rows = [(i, rng.randrange(1, 900), "x", "s", "b", "f") for i in range(500)] + [(600, None, "a b, c!", "s", "b", "f"), (601, None, None, "s", "b", "f"), (602, 0, "", "s", "b", "f"), (None, 5, "x", "s", "b", "f")]
    kinds = spark.createDataFrame([("small", 256), ("big", 1000), ("none", 0)], "container_kind string, capacity_tokens int")
    got = pack(spark.createDataFrame(rows, DOCS), kinds, block=128).toPandas()
    sizes = {r[0]: r[1] for r in rows[:500]} | {600: 5}
    for kind, capacity in (("small", 256), ("big", 1000)):
        part = got[got.container_kind == kind]
        assert part.groupby("doc_id").tokens.sum().to_dict() == sizes
        assert all(len(p) == -(-sizes[i] // capacity) for i, p in part.groupby("doc_id"))
        bins = part.groupby(["block", "container_no"])
        assert (bins.tokens.sum() <= capacity).all() and (bins.tokens.sum() == bins.fill.first()).all() and (bins.place.max() == bins.size()).all()
        assert len(bins) <= 1.06 * sum(sizes.values()) / capacity + 6
    assert pack(spark.createDataFrame([], DOCS), kinds).count() == 0 and pack(spark.createDataFrame(rows, DOCS), kinds.where("false")).count() == 0


def test_token_counts(spark):
    texts = [("Hello, world!! 3_x", 5), ("été… — ok", 4), ("", 0), ("   ", 0)]
    assert [r[0] for r in spark.createDataFrame([(t,) for t, _ in texts], "t string").select(wordpunct_count(F.col("t"))).collect()] == [n for _, n in texts]


# problem 9


def test_mix_shares_caps_and_epochs(spark):
    rng = random.Random(9)
    rows = [(i, rng.randrange(20, 400), "some text", "big" if i % 3 else "small" if i % 6 else "tiny", "b", "f") for i in range(3000)] + [(9000, None, None, "big", "b", "f"), (9001, 7, "x", None, "b", "f")]
    documents = spark.createDataFrame(rows, DOCS)
    targets = spark.createDataFrame([("m", "big", 0.5, 2), ("m", "small", 0.3, 3), ("m", "tiny", 0.2, 4), ("m", "absent", 0.1, 4), ("n", "tiny", 1.0, 2), ("o", "absent", 1.0, 1), (None, "big", 1.0, 1)], "mix_id string, source string, target_share double, max_repeats int")
    chosen = mix(documents, targets)
    got = chosen.toPandas()
    assert not got.duplicated(["mix_id", "doc_id"]).any() and set(got.mix_id) == {"m", "n"}
    caps = {"big": 2, "small": 3, "tiny": 4}
    assert all(r.repeats <= caps[r.source] for r in got.itertuples())
    part = got[got.mix_id == "m"]
    for _, p in part.groupby("source"):
        assert p.repeats.max() - p.repeats.min() <= 1, "complete epochs precede the sample"
    real = {(r.mix_id, r.source): r.actual_share for r in shares(chosen, targets.where("mix_id IS NOT NULL")).collect()}
    assert all(abs(real["m", s] - w / 1.0) < 0.01 for s, w in (("big", 0.5), ("small", 0.3), ("tiny", 0.2))) and real["m", "absent"] == 0 and real["n", "tiny"] == 1
    assert (got[got.mix_id == "n"].repeats == 2).all()
    again = mix(documents, targets).toPandas()
    assert sorted(map(tuple, got.values)) == sorted(map(tuple, again.values))
    other = mix(documents, targets, seed=1).toPandas()
    assert sorted(map(tuple, got.values)) != sorted(map(tuple, other.values))
    assert mix(documents.where("false"), targets).count() == 0 and mix(documents, targets.where("false")).count() == 0
    assert budgets(sized(documents), targets).where("mix_id = 'm'").count() == 3


def test_better_documents_are_taken_more_often(spark):
    rows = [(i, 100, "plain words only" if i % 2 else "#### 0000 ---- ////", "s", "b", "f") for i in range(2000)] + [(5000 + i, 100, "words", "t", "b", "f") for i in range(100)]
    targets = spark.createDataFrame([("m", "s", 0.9, 1), ("m", "t", 0.1, 1)], "mix_id string, source string, target_share double, max_repeats int")
    got = mix(spark.createDataFrame(rows, DOCS), targets).where("source = 's'").toPandas()
    assert (got.doc_id % 2).mean() > 0.6
