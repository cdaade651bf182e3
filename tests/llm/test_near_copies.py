import numpy as np
import pytest

from lendscape.llm import near_copies, simhash
from lendscape.session import Workspace

SCHEMA = "doc_id long, text string"


def sets(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def similarity(a, b):
    return len(a & b) / len(a | b)


def kept(spark, rows):
    return sorted(r[0] for r in simhash.survivors(spark, spark.createDataFrame(rows, SCHEMA), Workspace(spark, "near-test")).collect())


def edited(rng, words, changes):
    out = list(words)
    for at in rng.choice(len(out), changes, replace=False):
        out[at] = f"x{rng.integers(1 << 30)}"
    return out


def test_copies_from_the_threshold_up_go_and_others_stay(spark):
    rng = np.random.default_rng(5)
    rows, want = [], []
    for k in range(120):
        words = [f"w{n}" for n in rng.integers(0, 3000, 300)]
        other = edited(rng, words, int(rng.integers(1, 12)))
        pair = [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        rows += pair
        want += [2 * k] if similarity(*(sets(t) for _, t in pair)) >= 0.8 else [2 * k, 2 * k + 1]
    measured = [similarity(sets(rows[k][1]), sets(rows[k + 1][1])) for k in range(0, 240, 2)]
    assert sum(0.8 <= m < 0.95 for m in measured) > 40 and sum(m < 0.8 for m in measured) > 10
    assert kept(spark, rows) == want


def test_a_repeated_line_makes_no_copy(spark):
    rng = np.random.default_rng(6)
    line = "all rights are kept by us here always " * 300
    rows = [(k, line + " ".join(f"w{n}" for n in rng.integers(0, 100000, 100))) for k in range(6)]
    assert kept(spark, rows) == list(range(6))


def test_a_crowd_leaves_one_and_no_two_that_stay_are_near(spark):
    rng = np.random.default_rng(7)
    words = [f"w{n}" for n in rng.integers(0, 3000, 200)]
    rows = [(1000 + k, " ".join(edited(rng, words, 1))) for k in range(200)]
    chain = [f"v{n}" for n in rng.integers(0, 3000, 200)]
    for k in range(12):
        rows.append((k, " ".join(chain)))
        chain = edited(rng, chain, 3)
    left = kept(spark, rows)
    texts = {d: sets(t) for d, t in rows if d in left}
    assert 1000 in left and 0 in left and max(left) == 1000
    assert not [(a, b) for a in left for b in left if a < b and similarity(texts[a], texts[b]) >= 0.8]


def test_a_doc_id_with_two_texts_leaves_one_of_each_group(spark):
    rows = [(5, "a text of group one here"), (9, "a text of group one here"), (5, "some other text of group two"), (3, "some other text of group two")]
    rows += [(5, "a text of group one here"), (None, "a text of group one here")]
    left = simhash.survivors(spark, spark.createDataFrame(rows, SCHEMA), Workspace(spark, "near-test")).collect()
    assert sorted(((r[0] or -1), r[1][:4]) for r in left) == [(-1, "a te"), (3, "some"), (5, "a te")]


@pytest.mark.parametrize("unlike", [False, True])
def test_a_crowd_of_many_blocks(spark, monkeypatch, unlike):
    """Leaders of the blocks meet again; a crowd that stays unlike is compared block by block."""
    monkeypatch.setattr(near_copies, "BLOCK", 600)
    rng = np.random.default_rng(9)
    words = [f"w{n}" for n in rng.integers(0, 3000, 90)]
    rows = [(k, " ".join(edited(rng, words, 9 if unlike else 1))) for k in range(60)]
    rows += [(100 + k, rows[k][1].replace("x", "x", 1) + " end") for k in range(0, 60, 4)]
    if unlike:
        monkeypatch.setattr(near_copies, "keys", lambda sums, segments: np.zeros((len(sums), near_copies.KEYS[segments]), np.int64) + np.arange(near_copies.KEYS[segments]))
        monkeypatch.setattr(near_copies, "KEYS", {2: 2})
        monkeypatch.setattr(near_copies, "FARTHEST", 1.0)
    left = kept(spark, rows)
    texts = {d: sets(t) for d, t in rows}
    assert not [(a, b) for a in left for b in left if a < b and similarity(texts[a], texts[b]) >= 0.8]
    assert all(any(similarity(texts[d], texts[b]) >= 0.8 for b in texts if b != d) for d in texts if d not in left)
    assert len(left) == (60 if unlike else 1)


@pytest.mark.parametrize("segments", [2, 3])
def test_recall_of_the_keys(segments):
    """At least nine in ten at the threshold, more above it, and few strangers."""
    rng = np.random.default_rng(8)

    def all_keys(found):
        return near_copies.keys(np.array([near_copies.votes(f) for f in found]), segments)

    for size in (40, 400):
        for common, least in ((0.8, 0.9), (0.85, 0.95), (0.9, 0.98), (0.95, 0.99)):
            both = [rng.integers(0, 1 << 63, round(size * common)).astype(np.uint64) for _ in range(400)]
            rest = (size - round(size * common)) // 2
            sides = [[np.concatenate([b, rng.integers(0, 1 << 63, rest).astype(np.uint64)]) for b in both] for _ in range(2)]
            a, b = (all_keys(side) for side in sides)
            met = (a == b).any(axis=1).mean()
            assert met >= least, (size, common, met)
            assert (a == np.roll(b, 1, axis=0)).mean() < 3 / 4096**segments + 2e-4
    assert near_copies.segments_for(200_000) == 2 and near_copies.segments_for(10**8) == 3


def test_leaders_take_all_that_are_near():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 100).astype(np.uint64)
    found = [np.sort(base[k:]) for k in (0, 5, 10, 25, 30)] + [np.sort(rng.integers(0, 1 << 63, 100).astype(np.uint64))]
    bits = np.packbits(np.array([near_copies.votes(f) for f in found]) > 0, axis=1)
    assert near_copies.led_by(range(6), bits, found) == [(0, 1), (0, 2), (3, 2), (3, 4)]


def test_columns_keep_their_names(spark):
    rows = [(1, "one text", "mine1", 7, 8), (2, "one text", "mine2", 7, 8), (3, None, "mine3", 7, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _digest string, _first int, node int")
    left = simhash.survivors(spark, df, Workspace(spark, "near-test"))
    assert sorted(tuple(r) for r in left.collect()) == sorted([rows[0], rows[2]]) and left.columns == df.columns
    assert simhash.survivors(spark, df.limit(0), Workspace(spark, "near-test")).collect() == []


def test_stars_reach_the_same_with_fewer_links(spark):
    """A crowd whose members are each led by many: a link a member is left, and the leaders'."""
    rng = np.random.default_rng(3)
    rows = [(int(a), 100 + b) for b in range(300) for a in rng.choice(16, 12, replace=False)] + [(900, 901), (901, 900), (902, 901), (7, 7)]
    left = near_copies.stars(spark.createDataFrame(rows, "a long, b long")).collect()
    assert len(left) < 300 + 16 * 16 + 4 < len(rows) / 5
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for r in left:
        root[find(r.a)] = find(r.b)
    assert len({find(x) for x in [*range(16), *range(100, 400)]}) == 1
    assert find(900) == find(901) == find(902) != find(0) and 7 not in {r.b for r in left if r.a == r.b}


@pytest.mark.parametrize("words", [1 << 18, 2])
def test_texts_that_are_not_asked_for_do_not_travel(spark, monkeypatch, words):
    monkeypatch.setattr(near_copies.common, "FILTER_WORDS", words)
    rows = spark.createDataFrame([(k, f"k{k}".encode()) for k in range(2000)] + [(-1, None)], "n long, key binary")
    held = spark.createDataFrame([(f"k{k}".encode(),) for k in range(0, 2000, 40)] + [(None,)], "key binary")
    marked = near_copies.common.perhaps_in(rows, held, "key", "asked")
    got = {r.n: r.asked for r in marked.collect()}
    assert marked.columns == ["n", "key", "asked"] and len(got) == 2001 and not got[-1]
    assert all(got[k] for k in range(0, 2000, 40))
    assert (sum(got.values()) < 60) == (words > 2)
    # The rows themselves are not exchanged, only the words of the filter.
    plan = marked._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in plan


def test_keys_that_no_one_shares_travel_once_and_nothing_made_up_starts_workers(spark, monkeypatch):
    plans = {}

    class Watched(Workspace):
        def store(self, df, name):
            plans[name] = df._jdf.queryExecution().executedPlan().toString()
            return super().store(df, name)

    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{n}" for n in rng.integers(0, 3000, 60)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate([*texts, *(t + " end" for t in texts[:10])])), SCHEMA)
    monkeypatch.setattr(type(spark), "createDataFrame", None)
    _, led = near_copies.heads(spark, docs, Watched(spark, "near-test"))
    assert led.filter("node != head").count() == 10
    # The keys are taken apart for counting and for the filter, not again for those who share one.
    assert "Generate" in plans["shared"] and "Generate" not in plans["members"]
