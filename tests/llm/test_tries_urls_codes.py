import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lendscape.llm import prefix_trie, url_filter, vector_codes
from lendscape.session import Workspace

# ---- prefix trie

TURNS = "conv_id long, turn long, role string, text string, depth int, key string, owner string"


def plain_rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            said = hashlib.sha256((hashlib.sha256((role or "").encode()).hexdigest() + hashlib.sha256((text or "").encode()).hexdigest()).encode()).hexdigest()[:32]
            own[conv].append((turn is not None, turn, said, role or "", text or ""))
    own = {c: [t[3:] for t in sorted(turns, key=lambda t: (t[0], t[1] or 0, t[2]))] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def plain_trie(convs):
    """Node by node, straight from the definition."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = []
    for node, inside in members.items():
        below = [n for n in members if n[: len(node)] == node]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].split()) for n in below if n)
        out.append((
            inside[0], len(node), members[node[:-1]][0] if node else None, len(inside), len(children[node]),
            sum(not children[n] for n in below), saved, hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def conversations(rng):
    rows = []
    shared = [(rng.choice("ua"), " ".join(rng.choice("xyz") for _ in range(rng.randint(0, 4)))) for _ in range(6)]
    for c in [*range(90), *range(-45, -38), 10**12]:
        turns = shared[: rng.randint(0, 6)] + [(rng.choice(["u", "a", None]), rng.choice(["p q", "r", "", None])) for _ in range(rng.randint(0, 3))]
        rows += [(c, k, *t) for k, t in enumerate(turns)]
    rows += [(400 + k, t, *said) for k in range(30) for t, said in enumerate(shared)]
    rows += [(500, None, "u", "no turn"), (500, 3, "u", "later"), (500, 3, "u", "later"), (500, -1, "u", "first"), (None, 0, "u", "whose"), (501, 0, None, None)]
    rows += [(600, k, "u", f"step {k}") for k in range(300)] + [(601, k, "u", f"step {k}") for k in range(270)]
    return rows


@pytest.mark.parametrize("local", [1 << 13, 8, 1])
def test_trie_equals_brute_force(spark, monkeypatch, local):
    monkeypatch.setattr(prefix_trie, "TURNS_PER_CELL", 7)
    monkeypatch.setattr(prefix_trie, "IDS_PER_CHUNK", 4)
    rows = conversations(random.Random(5))
    df = spark.createDataFrame([(*r, 1, "k", "o") for r in rows], TURNS).repartition(5)
    got = prefix_trie.shared_trie(spark, df, Workspace(spark, "trie-test"), local)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_trie(plain_rebuilt(rows))


def test_trie_of_conversations_as_they_are(spark):
    rows = [(1, 0, "u", "a b"), (1, 1, "a", "c"), (2, 0, "u", "a b"), (2, 1, "a", "d"), (3, 0, "u", "a b"), (3, 1, "a", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = prefix_trie.placed(prefix_trie.said(df))
    got = prefix_trie.trie(spark, prefix_trie.as_they_are(turns), Workspace(spark, "trie-test")).collect()
    convs = {c: [r[2:] for r in rows if r[0] == c] for c in (1, 2, 3)}
    assert sorted((tuple(r) for r in got), key=str) == plain_trie(convs)


def test_no_conversation_has_no_node(spark):
    df = spark.createDataFrame([(None, 0, "u", "t", 1, "k", "o")], TURNS)
    for rows in (df, df.limit(0)):
        assert prefix_trie.shared_trie(spark, rows, Workspace(spark, "trie-test")).collect() == []


def test_centroid_sums_of_a_long_chain_and_a_star():
    for parent in ([-1, *range(4999)], [-1, *[0] * 4999], [-1, -1, *[k // 2 for k in range(2, 5000)]]):
        n = len(parent)
        values = np.arange(2 * n).reshape(n, 2)
        want, mass = values.copy(), np.ones(n, np.int64)
        for k in range(n - 1, -1, -1):
            if parent[k] >= 0:
                want[parent[k]] += want[k]
                mass[parent[k]] += mass[k]
        assert (prefix_trie.local_sums(np.array(parent), mass, values) == want).all()


# ---- URL verdicts

URLS = [
    ("http://A.com/x?y", "a.com", "/x"), ("https://www.Example.com/en/1#t", "www.example.com", "/en/1"), ("//no/scheme", "", ""), (None, "", ""),
    ("", "", ""), ("x://h", "h", ""), ("x://h?q/p", "h", ""), ("a://b://c/d", "b:", "//c/d"), ("u://ÄB.net/es/é", "Äb.net", "/es/é"), ("u://\n/p", "\n", "/p"),
]


def test_hosts_and_paths(spark):
    df = spark.createDataFrame([(k, u) for k, (u, _, _) in enumerate(URLS)], "id int, url string")
    got = {r.id: (r.h, r.p) for r in df.select("id", url_filter.host_of("url").alias("h"), url_filter.path_of("url").alias("p")).collect()}
    assert got == {k: (h, p) for k, (_, h, p) in enumerate(URLS)}


def test_registered_domains(spark):
    want = {
        "a.b.example.com": ("example.com", "com"), "example.com": ("example.com", "com"), "com": ("com", "com"), "": ("", ""),
        "x.y.co.uk": ("y.co.uk", "co.uk"), "co.uk": ("co.uk", "uk"), "me@x.org:80": ("x.org", "org"), "10.0.0.1:8080": ("10.0.0.1", "10.0.0.1"),
        "x.uk": ("x.uk", "uk"), "y.x.uk": ("x.uk", "uk"),
    }
    df = spark.createDataFrame([(h,) for h in want], "host string")
    host = df["host"]
    got = {r.host: (r.d, r.s) for r in df.select("host", url_filter.domain_of(host).alias("d"), url_filter.suffix_of(host).alias("s")).collect()}
    assert got == want


def judged(spark, pages, labels):
    df = spark.createDataFrame([(*p, "h", 0.5) for p in pages], "page_id long, url string, host string, low double")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return url_filter.judge(spark, df, url_filter.outcomes(known), Workspace(spark, "url-test"))


def test_the_longest_rule_wins(spark):
    want = {
        "http://com/": ("com/", "allow"), "http://x.com/a": ("com/", "allow"), "http://example.com/en/": ("example.com/en/", "block"),
        "http://b.example.com/en/x": ("example.com/en/", "block"), "http://www.example.com/en/x": ("www.example.com/en/", "allow"),
        "http://m.www.example.com/en/x": ("www.example.com/en/", "allow"), "http://www.example.com/en": ("com/", "allow"), "http://x.com": (None, "allow"),
        "http://example.net/es/1": ("net/es/", "block"), "http://net/fr/": ("net/fr/", "block"), "http://planet/fr/": (None, "allow"), "http://x.net/de/": (None, "allow"),
    }
    got = judged(spark, [(k, u) for k, u in enumerate(want)], []).collect()
    assert {list(want)[r.page_id]: (r.rule, r.verdict) for r in got} == want


def test_reputation_blocks_what_is_surely_bad_and_lends_to_siblings(spark):
    pages, labels = [], []

    def host(name, n, bad, labelled=True):
        for k in range(n):
            page = len(pages)
            pages.append((page, f"http://{name}/p/{k}"))
            if labelled:
                labels.append((page, 0 if k < bad else 1, 0))

    for k in range(60):
        host(f"h{k}.good{k % 20}.org", 20, 1)
    host("bad.mixed.org", 80, 76)
    host("fine.mixed.org", 80, 2)
    host("short.mixed.org", 1, 1)
    for k in range(12):
        host(f"s{k}.spam.org", 30, 29)
    host("new.spam.org", 3, 0, labelled=False)
    labels += [(0, None, 1), (0, 1, 0), (None, 0, 1), (10**9, 0, 1), (5, None, None)]
    pages += [(3, "http://h0.good0.org/again"), (None, "http://bad.mixed.org/unnamed"), (None, None)]
    out = judged(spark, pages, labels).collect()
    assert len(out) == len(pages)
    verdicts = defaultdict(set)
    for r in out:
        verdicts[r.host].add(r.verdict)
    blocked = {h for h, v in verdicts.items() if v == {"block"}}
    assert blocked == {"bad.mixed.org", "new.spam.org", *[f"s{k}.spam.org" for k in range(12)]}
    assert all(len(v) == 1 for v in verdicts.values())
    df = spark.createDataFrame([(*p, "h") for p in pages], "page_id long, url string, _host string")
    passed = url_filter.allowed(spark, df, url_filter.outcomes(spark.createDataFrame(labels, "doc_id long, quality int, toxic int")), Workspace(spark, "url-test"))
    assert passed.columns == df.columns and passed.count() == sum(r.verdict == "allow" for r in out) and passed.first()["_host"] == "h"


def test_no_pages_and_no_labels(spark):
    assert judged(spark, [], []).collect() == []
    assert judged(spark, [(1, "http://a.org/"), (1, "http://a.org/")], []).count() == 2


# ---- vector codes


def plain_codes(rows, rounds=4):
    kept = [(i, [(1024 * x).__floor__() for x in v], label) for i, v, label in rows if v and all(x is not None and np.isfinite(x) for x in v) and len(v) == 8]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = lambda v: [v[2 * p : 2 * p + 2] for p in range(4)]
    books = [[cut(v)[p] for _, v, _ in kept[:256]] for p in range(4)]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda p, w: min((distance(w, e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(4):
            groups = defaultdict(list)
            for _, v, _ in kept:
                groups[nearest(p, cut(v)[p])[1]].append(cut(v)[p])
            books[p] = [[sum(x) // len(groups[k]) for x in zip(*groups[k], strict=True)] if k in groups else e for k, e in enumerate(books[p])]
    found = [(i, [nearest(p, cut(v)[p]) for p in range(4)], label) for i, v, label in kept]
    errors = defaultdict(int)
    for _, best, label in found:
        errors[label] += sum(d for d, _ in best)
    top = (1 << 63) - 1
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted([(i, "".join(f"{k:02x}" for _, k in b), min(sum(d for d, _ in b), top), min(errors[label], top), sha) for i, b, label in found], key=str)


SCHEMA = "vec_id long, embedding array<double>, label int, parts string, error string"


@pytest.mark.parametrize("large", [1.0, 1e9])
def test_codes_equal_brute_force(spark, large):
    rng = np.random.default_rng(3)
    rows = [(k, (rng.integers(-3, 4, 8) * 0.01 * (1 if k % 50 else large)).tolist(), k % 3 if k % 5 else None) for k in range(400)]
    rows += [(1000, [0.0] * 8, 1), (1001, None, 1), (1002, [float("nan")] * 8, 1), (1003, [None] + [1.0] * 7, 1), (1004, [], 1), (1005, [1.0] * 3, 1)]
    rows += [(1006, [1.0] * 12, 1), (None, rows[9][1], 2), (9, rows[9][1], 2), (9, rows[9][1], 2), (1007, [float("inf")] * 8, 0), (1008, rows[3][1], 7)]
    df = spark.createDataFrame([(*r, "p", "e") for r in rows], SCHEMA).repartition(4)
    got = vector_codes.coded(spark, df, Workspace(spark, "codes-test"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_codes(rows)


def test_few_equal_and_no_vectors(spark):
    ws = Workspace(spark, "codes-test")
    empty = spark.createDataFrame([], SCHEMA)
    assert vector_codes.coded(spark, empty, ws).collect() == []
    rows = [(k, [0.5] * 8, 1) for k in range(300)]
    df = spark.createDataFrame([(*r, "p", "e") for r in rows], SCHEMA)
    assert sorted((tuple(r) for r in vector_codes.coded(spark, df, Workspace(spark, "codes-test")).collect()), key=str) == plain_codes(rows)


def test_codes_stand_for_their_entries(spark):
    rows = [(k, [0.1 * k, -0.1 * k, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0], 0) for k in range(40)]
    codes, books = vector_codes.encode(spark, spark.createDataFrame([(*r, "p", "e") for r in rows], SCHEMA), Workspace(spark, "codes-test"))
    back = {r.vec_id: r.parts for r in vector_codes.decoded(codes, books).collect()}
    assert back[7] == [int(np.floor(1024 * x)) for x in rows[7][1]]


@pytest.mark.parametrize("dtype", [np.float64, object])
def test_search_tree_finds_the_nearest_and_spares_comparisons(dtype):
    rng = np.random.default_rng(0)
    centers = rng.integers(-1000, 1000, (12, 4))
    entries = (centers[rng.integers(0, 12, 256)] + rng.integers(-20, 20, (256, 4))).astype(dtype)
    entries[200] = entries[10]
    queries = np.concatenate([entries[:, :] + 1, rng.integers(-1000, 1000, (300, 4)).astype(dtype)])
    tree = vector_codes.Gnat(entries)
    index, best = tree.nearest(queries)
    every = ((queries[:, None, :] - entries[None]) ** 2).sum(axis=2).astype(np.float64)
    assert (index == every.argmin(axis=1)).all() and (best.astype(np.float64) == every.min(axis=1)).all()
    assert tree.compared < 0.6 * every.size
