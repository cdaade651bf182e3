import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lendscape.llm import simhash
from lendscape.session import Workspace

SCHEMA = "doc_id long, text string, component_id string, fp int"


def plain(text, width=3):
    """The fingerprint bit by bit."""
    out, word = [], b""
    for byte in (text or "").encode():
        if byte in b" \t\n\v\f\r":
            out, word = (out + [word] if word else out), b""
        else:
            word += bytes([byte + 32 if 65 <= byte <= 90 else byte])
    words = out + [word] if word else out
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + width]) for k in range(len(words) - width + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    """Components over all pairs of documents."""
    prints = [plain(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                group[root(i)] = root(j)
    ids = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            ids[root(k)] = min(d, ids.get(root(k), d))
    return sorted(((d, f"{p:016x}", ids.get(root(k))) for k, ((d, _), p) in enumerate(zip(rows, prints, strict=True))), key=str)


def run(spark, rows):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    ws = Workspace(spark, "simhash-test")
    out = [tuple(r) for r in simhash.near_duplicates(spark, df, ws).collect()]
    ws.remove()
    return sorted(out, key=str)


def test_the_code_is_perfect():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 2000).astype(np.uint32)
    found = simhash.codeword(words)
    assert (simhash.codeword(words ^ simhash._tables()[2][simhash._tables()[0][words & 0xFFF] ^ simhash._tables()[1][words >> 12]]) == found).all()
    near = simhash._neighbours(words, 23)
    assert near.shape[1] == 6 and ((near >= 0).sum(1) >= 1).all()


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
def test_keys_meet_for_every_link(bits):
    rng = np.random.default_rng(bits)
    a = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
    b = a.copy()
    for k in range(len(a)):
        for place in rng.choice(64, bits, replace=False):
            b[k] ^= np.uint64(1) << np.uint64(place)
    met = np.zeros(len(a), bool)
    offered, asked = simhash.keys(a, True), simhash.keys(b, False)
    pairs = set(zip(*(x.tolist() for x in offered), strict=True))
    for row, key in zip(*(x.tolist() for x in asked), strict=True):
        met[row] |= (row, key) in pairs
    assert met.all()


def test_fingerprints_equal_the_plain_ones():
    texts = [None, "", " \n", "One", "one two", "A b C d e", "é È ß\x0bq " * 9, "w " * 70000, "x" * 50000]
    assert [simhash.fingerprint(t) for t in texts[:-2]] == [plain(t) for t in texts[:-2]]
    assert simhash.fingerprint(texts[-2]) == plain("w w w") and simhash.fingerprint(texts[-1]) == plain(texts[-1])


def test_components_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(40):
        words = list(rng.choice(vocabulary, 300))
        for _ in range(4):
            rows.append((len(rows), " ".join(words)))
            words[rng.integers(300)] = "z"
    rows += [(1000, rows[0][1].upper()), (900, None), (901, ""), (902, "\t"), (None, "no id"), (None, None), (903, "two words"), (903, "two words")]
    assert run(spark, rows) == brute(rows)


def test_a_crowd_of_copies_and_an_empty_table(spark):
    rows = [(k, "the same text over and over") for k in range(3000)] + [(5000 + k, f"doc {k} has words of its own {k * k}") for k in range(50)]
    assert {r[2] for r in run(spark, rows) if r[0] < 3000} == {0}
    assert run(spark, []) == []


def test_one_of_each_group_stays(spark):
    rows = [(3, "a b c d"), (1, "a b c d"), (1, "a b c d"), (7, "other words here now"), (None, "a b c d")]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    kept = simhash.survivors(spark, df, Workspace(spark, "simhash-test"))
    assert kept.columns == df.columns
    assert sorted((r[0] or -1) for r in kept.collect()) == [-1, 1, 7]


def test_no_link_needs_all_pairs(spark):
    prints = spark.range(500).select(F.xxhash64("id").alias("fp"))
    plan = simhash.links(prints, 4)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_keys_are_never_broadcast(spark):
    """However few fingerprints the planner sees: 72 keys of each would have to fit in the driver."""
    prints = spark.range(500).select(F.xxhash64("id").alias("fp"))
    found = simhash.links(prints, 4)
    assert found.collect() == []
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
