import corpus_pipeline
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, key string, fp long"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, lang, s, len(t or ""), "x", "y", 1) for d, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    out = [(k, f"the quick fox number {k} and the river of words {k * k} came to {k * 7} again", "en", f"s{k % 4}") for k in range(60)]
    out += [(100 + k, f"der schnelle fuchs nummer {k} und ein fluss {k * 3} von worten", "de", None) for k in range(30)]
    out += [(200, out[3][1], "en", "s3"), (201, out[3][1], "en", "s0"), (5, out[5][1], "en", "s1"), (202, "write to someone@mail.org now please", "en", "s0")]
    out += [(300, None, "en", "s0"), (301, "", None, "s1"), (302, "12 + 4", "en", None), (303, "long words " * 30000, "en", "s2"), (None, "a text without an id", "en", "s1")]
    return out


def test_stages_hand_on_what_they_keep(spark, rows):
    docs = frame(spark, rows)
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        seen[name] = docs.collect()
        docs = spark.createDataFrame(seen[name], docs.schema)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns, name
    ids = lambda name: sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in seen[name])
    everything = sorted(-1 if r[0] is None else r[0] for r in rows)
    assert ids("language_id") == [d for d in everything if d not in (300, 301, 302)]
    assert ids("simhash_near_dedup") == sorted({d for d in everything if d not in (300, 301, 302, 200, 201)})
    assert ids("pii") == ids("simhash_near_dedup")
    assert next(r["text"] for r in seen["pii"] if r["doc_id"] == 202) == "write to [email] now please"
    assert set(ids("mixing")) <= set(ids("pii")) and max(ids("mixing").count(d) for d in ids("mixing")) <= 3
    packed = seen["packing"]
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in seen["mixing"]}
    total = {}
    for r in packed:
        total[r["sequence_id"]] = total.get(r["sequence_id"], 0) + r["length"]
    assert max(total.values()) <= 2048


def test_stages_take_an_empty_table(spark, rows):
    docs = frame(spark, rows[:1]).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), stage(spark, docs, "").schema)
    assert docs.count() == 0


def test_run_equals_the_stages(spark):
    sf = "/root/testdata/sf0.001"
    got = corpus_pipeline.run(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), stage(spark, docs, sf).schema)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(str, got.select(key).collect())) == sorted(map(str, docs.select(key).collect()))
