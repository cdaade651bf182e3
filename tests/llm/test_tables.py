import hashlib
import math
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from lendscape.llm import embeddings, mixing, sharding, warc
from lendscape.llm.queries import QUERIES
from lendscape.llm.sql import ANSWERS
from lendscape.session import Workspace

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ANSWERS))
def test_query_matches_its_answer(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings", "conversations", "labels"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = con.execute(ANSWERS[name]).fetchdf()
    got = QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    order = list(got.columns[:2])
    got, want = (x.sort_values(order).reset_index(drop=True).astype(object) for x in (got, want[list(got.columns)]))
    assert got.where(got.notna(), None).equals(want.where(want.notna(), None))


# ---- archives

PAGES = "page_id long, url string, html string, digest string, key string"


def test_archives_give_back_what_went_in(spark):
    big, other = "é" * 600, "<p>x</p>" * 200
    rows = [(k, f"http://www.Host{k % 3}.example.com/p/{k}?a=b c#f", big) for k in range(40)]
    rows += [(100, "https://a.b/x", other), (101, "https://a.b/x", other), (102, None, "small"), (103, "", None), (104, "http://[bad", "small"), (None, "http://n.l/", big)]
    rows += [(105, "ftp://h:99/\tq ", ""), (106, "http://l.ong/", "long " * 200000), (101, "https://a.b/x", other)]
    df = spark.createDataFrame([(*r, "d", "k") for r in rows], PAGES)
    want = []
    heads = defaultdict(list)
    for page, _, html in rows:
        heads[html or ""].append(page)
    for page, _, html in rows:
        data = (html or "").encode()
        head = max((p for p in heads[html or ""] if p is not None), default=None) if len(data) >= 1000 else None
        later = head is not None and page != head
        want.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if later else "response", head if later else None))
    got = [tuple(r) for r in warc.round_trip(spark, df, Workspace(spark, "warc-test")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.round_trip(spark, df.limit(0), Workspace(spark, "warc-test")).collect() == []


def test_keys_are_found_in_their_blocks_only(spark):
    rng = random.Random(4)
    rows = [(f"k{rng.randint(0, 80):03d}", k, "f", k, 1) for k in range(900)] + [("hot", k, "f", k, 1) for k in range(1000, 1600)]
    df = spark.createDataFrame(rows, "urlkey string, page_id long, path string, offset long, length long")
    ws = Workspace(spark, "warc-test")
    index = ws.store(warc.write_index(df, ws.folder("index"), 5, block_lines=7), "parts")
    wanted = ["k000", "k040", "k080", "hot", "a", "zz", "k0405"]
    keys = spark.createDataFrame([(k,) for k in wanted], "urlkey string")
    got = sorted(r["offset"] for r in warc.lookup(keys, index, 3).collect())
    assert got == sorted(r[3] for r in rows if r[0] in wanted)
    listed = sorted((r["last"], r["first"], r["cdx"], r["idx"]) for r in index.collect())
    assert len(list(warc.locate("k040", listed))) < 8 and not list(warc.locate("zz", listed))


def test_url_keys():
    assert warc.url_key("HTTP://user@WWW.Example.com:80/A?b=C#d") == "com,example)/a?b=c"
    assert warc.url_key("https://x.org:8443") == "org,x:8443)/" and warc.url_key(None) == warc.url_key("") == "-"
    assert "\t" not in warc.url_key("http://a/\t\n ")


# ---- mixing

DOCS = "doc_id long, text string, source string, key string, size int, draw string"


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = 3.0 * sizes[s]
        free -= over
        left = float(sum(sizes.values())) - sum(target.values())
    return target


def test_mix_meets_its_targets(spark):
    rng = random.Random(2)
    rows = [(k, "w " * rng.choice([0, 1, 5, 300, 4000]), rng.choice(["a", "a", "a", "b", "B", "c", "é", None])) for k in range(400)]
    rows += [(900, None, "a"), (901, "w", "tiny"), (None, "no id here", "a"), (902, "same row", "b"), (902, "same row", "b"), (903, "", "empty")]
    df = spark.createDataFrame([(*r, "k", 1, "d") for r in rows], DOCS)
    got = mixing.mix(spark, df, Workspace(spark, "mix-test")).toPandas()
    again = mixing.mix(spark, df.repartition(3), Workspace(spark, "mix-test")).toPandas()
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    assert sorted(map(str, got[columns].values.tolist())) == sorted(map(str, again[columns].values.tolist()))
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    want = plain_targets(sizes)
    assert len(got) == len(rows) and (got["taken"] <= 3 * got["size"]).all()
    for source, target in want.items():
        own = got[got["key"] == ("~" if source is None else f"={source}")]
        assert own["target"].iloc[0] == pytest.approx(target, abs=1e-6) and abs(own["taken"].sum() - target) <= 4 * mixing.BLOCK_WORDS
    mixed = mixing.mixture(spark, df, Workspace(spark, "mix-test"))
    assert mixed.columns == df.columns
    copies = defaultdict(int)
    for r in mixed.collect():
        copies[r["doc_id"]] += 1
    for r in got.itertuples():
        if r.size and r.doc_id != 902 and r.taken % r.size == 0:
            assert copies[None if r.doc_id != r.doc_id else r.doc_id] == r.taken // r.size
    assert mixing.mix(spark, df.limit(0), Workspace(spark, "mix-test")).collect() == []


def test_schedule_holds_every_share_in_every_stretch(spark):
    sources = spark.createDataFrame([("=a", 0.6, 6000.0), ("=b", 0.9, 6000.0), ("=c", 1.0, 6000.0)], "key string, upto double, slots double")
    slots = sorted(mixing.schedule(spark, sources).collect(), key=lambda r: r["slot"])
    assert [r["slot"] for r in slots] == list(range(6000))
    seen = defaultdict(int)
    for r in slots:
        assert r["k"] == seen[r["key"]]
        seen[r["key"]] += 1
        for key, share in (("=a", 0.6), ("=b", 0.3), ("=c", 0.1)):
            assert abs(seen[key] - share * (r["slot"] + 1)) < 4


def test_every_stretch_of_the_mix_holds_the_sources_in_proportion(spark):
    rng = random.Random(3)
    rows = [(k, "w " * rng.randint(20, 60), "abc"[min(k % 7, 2)]) for k in range(4000)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, source string, _mix_times string")
    mixed = mixing.mixture(spark, df, Workspace(spark, "mix-test"), slot="_mix_id")
    assert mixed.columns == [*df.columns, "_mix_id"]
    out = sorted(mixed.collect(), key=lambda r: (r["_mix_id"], r["doc_id"]))
    words = {r["doc_id"]: len(r["text"].split()) for r in out}
    want = plain_targets({s: sum(len(t.split()) for _, t, o in rows if o == s) for s in "abc"})
    total = sum(want.values())
    for at in range(0, len(out) - 600, 300):
        part = out[at : at + 600]
        size = sum(words[r["doc_id"]] for r in part)
        for source, target in want.items():
            assert abs(sum(words[r["doc_id"]] for r in part if r["source"] == source) / size - target / total) < 0.06
    assert mixing.mixture(spark, df.limit(0), Workspace(spark, "mix-test"), slot="at").collect() == []


# ---- vectors


def plain_links(rows):
    units = {}
    for k, (_, v) in enumerate(rows):
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            scaled = np.array(v, float) / np.abs(np.array(v, float)).max()
            units[k] = scaled / np.linalg.norm(scaled)
    n, group = [0] * len(rows), list(range(len(rows)))
    for i in units:
        for j in units:
            if i != j and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.95:
                n[i] += 1
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    out = []
    for k, (vec, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[k] and rows[j][0] is not None]
        head = min(ids, default=None)
        out.append((vec, n[k], head, vec is not None and vec == head))
    return out


@pytest.mark.parametrize("block", [512, 8])
def test_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(7)
    rows = [(k, rng.standard_normal(32).tolist()) for k in range(300)]
    center = rng.standard_normal(32)
    rows += [(1000 + k, (center + 0.1 * rng.standard_normal(32)).tolist()) for k in range(80)]
    rows += [(2000 + k, rows[5][1]) for k in range(60)] + [(2100, [3 * x for x in rows[5][1]])]
    step, chain = rng.standard_normal(32), rng.standard_normal(32)
    rows += [(3000 - k, (chain + 0.22 * k * step).tolist()) for k in range(12)]
    rows += [(4000, None), (4001, [0.0] * 32), (4002, [float("nan")] * 32), (4003, [float("inf")] + [1.0] * 31), (4004, []), (4005, [None] + [1.0] * 31), (4006, [1.0, 2.0]), (4007, [2.0, 4.0]), (None, rows[7][1])]
    rows += [(4008, [1e-200] * 32), (4009, [1e200] * 32), (4010, [-0.0] + [1.0] * 31), (4011, [0.0] + [1.0] * 31)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, head string")
    got = [tuple(r) for r in embeddings.near_duplicates(spark, df, Workspace(spark, "vec-test")).collect()]
    assert sorted(got, key=str) == sorted(plain_links(rows), key=str)


def test_recall_at_the_threshold():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((3000, 64))
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.951 * a + math.sqrt(1 - 0.951**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    for classes in (1000, 1_000_000):
        k, tables = embeddings.parameters(classes)
        met = (embeddings.bucket_keys(a, k, tables) == embeddings.bucket_keys(b, k, tables)).any(1).mean()
        assert met > 0.97, (k, tables, met)
        strange = (embeddings.bucket_keys(a, k, tables) == embeddings.bucket_keys(np.roll(a, 1, 0), k, tables)).mean()
        assert strange < 20 / classes + 1e-3


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.near_duplicates(spark, df, Workspace(spark, "vec-test")).collect() == []


# ---- shards


def plain_shard(key, node):
    while node.children:
        def cost(child):
            text = f"{sharding.SEED}|{'' if key is None else key}|{child.name}"
            drawn = int(hashlib.md5(text.encode()).hexdigest()[:13], 16)
            return -math.log((drawn + 1) / (2**52 + 1)) / child.weight
        node = node.children[0] if len(node.children) == 1 else min(node.children, key=cost)
    return node.shard


def test_shards_follow_the_tree_and_one_more_takes_into_itself_only(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_CELL", 16)
    rows = [(k, f"text {k % 50} é", "x", 1) for k in range(2000)] + [(None, None, "x", 1), (7, "", "x", 1), (7, "", "x", 1), (9, "long " * 99999, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string, slot int")
    got = sharding.sharded(spark, df, ws=Workspace(spark, "shard-test")).collect()
    assert len(got) == len(rows)
    root = sharding.tree(8)
    for r in got:
        assert r["shard"] == plain_shard(r["doc_id"], root) and r["grown_shard"] == plain_shard(r["doc_id"], sharding.grown(root, 8))
        assert r["grown_shard"] in (r["shard"], 8)
    for s in range(8):
        own = [r for r in got if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == list(range(len(own))) and 180 < len(own) < 330
    assert 150 < sum(r["grown_shard"] == 8 for r in got) < 300
    assert sharding.sharded(spark, df.limit(0), ws=Workspace(spark, "shard-test")).collect() == []


def test_a_weight_moves_rows_into_its_subtree_only():
    leaf = lambda s, w=1.0: sharding.Node(f"shard{s}", shard=s, own_weight=w)
    build = lambda w: sharding.Node("root", (sharding.Node("r0", (leaf(0), leaf(1))), sharding.Node("r1", (leaf(2), leaf(3, w)))))
    before, after = build(1.0), build(2.0)
    moved = [(plain_shard(k, before), plain_shard(k, after)) for k in range(4000)]
    assert {b for a, b in moved if a != b} <= {2, 3} and all(not (a == 3 and b != 3) for a, b in moved)
    assert not any({a, b} == {0, 1} for a, b in moved)


def test_shard_files_hold_the_documents(spark, tmp_path):
    df = spark.createDataFrame([(k, f"t{k}") for k in range(100)], "doc_id long, text string")
    sharding.write_shards(df, str(tmp_path / "shards"), sharding.tree(4), rows_per_file=10)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == 100 and back.select("shard").distinct().count() == 4
