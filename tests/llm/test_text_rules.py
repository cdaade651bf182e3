import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendscape.llm import fertility, language, pii
from lendscape.session import Workspace

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, lang_pred string, _p int, _f int, _marks int"


def docs(spark, rows):
    return spark.createDataFrame([(d, t, lang, "s", len(t or ""), "x", "y", 1, 2, 3) for d, t, lang in rows], SCHEMA)


# ---- personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def passes(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_spans(text):
    """The patterns as they are written down."""
    only = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 14 <= len(only(m[0])) <= 19 and passes(only(m[0]))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(only(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], ["email", "ip", "card", "phone"].index(s[0])))


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    parts = ["a", "@", ".", "-", "x.y", "4", "11", "4111111111111111", "255", "256", "0001", " ", "+", "(", ")", "é", "b@c.de", "1.2.3.4", "\n", "@@", "%", "٣"]
    for _ in range(30000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == plain_spans(text), text


@pytest.mark.parametrize("text", ["a" * 300000, "@" * 100000, "a@" * 100000, "1" * 100000, "1." * 100000, "+1(" * 100000, "0" * 5000 + ".1.1.1", None, ""])
def test_endless_runs_end(text):
    assert isinstance(pii.base_spans(text), list)


def test_terms_that_give_an_entity_away(spark):
    rows = [(k, f"zanzibar keeper wrote to boss{k % 2}@corp.com on day {k} about item {k * 7}", None) for k in range(12)]
    rows += [(100 + k, f"plain talk about day {k} with nobody {k * 3}", None) for k in range(300)]
    rows += [(500 + k, "a copied note from hermit@cave.org says moonbeam", None) for k in range(200)]  # one text: no evidence
    rows += [(900, None, None), (901, "", None), (902, "the zanzibar Keeper again", None), (None, "mail me@x.yz", None)]
    df = docs(spark, rows)
    ws = Workspace(spark, "pii-test")
    terms = {r["term"]: r["share"] for r in pii.disclosing_terms(df, ws).collect()}
    assert {"zanzibar", "keeper"} <= set(terms) and not {"moonbeam", "day", "about"} & set(terms)
    got = {r["doc_id"]: r for r in pii.find(spark, df, Workspace(spark, "pii-test")).collect()}
    assert len(got) == len(rows)
    for doc_id, text, _ in rows:
        base = plain_spans(text or "")
        assert got[doc_id]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        assert {f"{k}:{s}:{e}" for k, s, e in base} <= set(got[doc_id]["spans"].split(",")) | {""}
    assert "term:4:12" in got[902]["spans"] and got[500]["spans"] == "email:19:34"
    clean = pii.cleaned(spark, df, Workspace(spark, "pii-test"))
    assert clean.columns == df.columns
    texts = {r["doc_id"]: r for r in clean.collect()}
    assert texts[500]["text"] == "a copied note from [email] says moonbeam" and texts[500]["n_chars"] == 40
    assert texts[900]["text"] is None and texts[901]["text"] == "" and "zanzibar" not in texts[902]["text"]
    assert pii.find(spark, df.limit(0), Workspace(spark, "pii-test")).collect() == []


def test_rare_entities_and_far_terms_are_judged(spark):
    rng = random.Random(6)
    far = lambda: " ".join(f"filler{n}" for n in rng.sample(range(40), 40))
    rows = [(k, f"Quillfeather wrote in week {k} {far()} reach r{k}q at quill@nest.org", None) for k in range(4)]
    rows += [(100 + k, f"plain talk {far()} about week {k} with nobody", None) for k in range(200)]
    near = far()
    rows += [(600 + k, f"Inkwell wrote in week {k} {near} write to ink@nest.org", None) for k in range(4)]  # near copies: one text
    rows += [(400 + k, "one text only hermit@cave.org moonbeam", None) for k in range(9)]
    ws = Workspace(spark, "pii-test")
    terms = {r["term"]: r["share"] for r in pii.disclosing_terms(docs(spark, rows), ws).collect()}
    assert terms["quillfeather"] >= pii.REMOVE and not {"moonbeam", "inkwell", "filler3", "week", "r1q"} & set(terms)


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    rows = [(k, f"alpha beta gamma mail a@b.cd here {k} {k * 31} and more of it {k * 17}", None) for k in range(10)] + [(50 + k, f"quiet {k}", None) for k in range(90)]
    df = docs(spark, rows)
    terms = pii.disclosing_terms(df, Workspace(spark, "pii-test"))
    marked = [pii.with_marks(df, terms, Workspace(spark, "pii-test"), "found", size).select("doc_id", "found").collect() for size in (32, 1 << 20)]
    once, again = (sorted((r["doc_id"], sorted((r["found"] or {}).items())) for r in rows) for rows in marked)
    assert once == again and any(found for _, found in once)


def plain_terms(rows):
    """Shares and evidence straight from their definitions."""
    texts = [t or "" for _, t, _ in rows]
    found = [(pii.entities(t), pii.terms_of(t), {w for w in pii.WORDS.findall(t.lower()) if len(w) > 1}) for t in texts]
    n_entity, n_term, n_both, seen, different = Counter(), Counter(), Counter(), defaultdict(set), defaultdict(set)
    for text, (entities, terms, words) in zip(texts, found, strict=True):
        n_term.update(words)
        for e in entities:
            n_entity[e] += 1
            different[e].add(text)
            for w in terms:
                n_both[e, w] += 1
                seen[e, w].add(pii.witness(text))
    asked = [pair for pair in n_both if len(different[pair[0]]) > 1]

    def bits(e, w):
        hits = len(seen[e, w]) - 1
        trials = hits + n_term[w] - n_both[e, w]
        if not hits:
            return 0.0
        rate, chance = hits / trials, n_entity[e] / len(rows)
        missed = (1 - rate) * math.log2((1 - rate) / (1 - chance)) if rate < 1 else 0.0
        return trials * (rate * math.log2(rate / chance) + missed) if rate > chance else 0.0

    ranked = sorted(((bits(*pair), pair) for pair in asked), reverse=True)
    last = max((k for k, (b, _) in enumerate(ranked, 1) if 2.0**-b <= pii.CHANCE * k / len(asked)), default=0)
    out = {}
    for _, (e, w) in ranked[:last]:
        share = math.log2(n_both[e, w] * len(rows) / n_entity[e] / n_term[w]) / math.log2(len(rows) / n_entity[e])
        if share >= pii.GENERALISE:
            out[w] = max(out.get(w, 0), share)
    return out


def test_shares_and_evidence_equal_brute_force_and_planted_terms_are_caught(spark):
    rng = random.Random(4)
    talk = lambda n: " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(n))
    rows = []
    for k in range(8):
        rows += [(len(rows), f"{talk(30)} nick{k} sends {talk(20)} user{k}@mail{k}.org {talk(9)}", None) for _ in range(6)]
    for k in range(150):
        # A single text of an address, and two of the same by chance beside a rare word.
        rows.append((len(rows), f"{talk(40)} rare{k} once{k}@x.org {talk(30)}", None))
        rows += [(len(rows) + j, f"{talk(30)} memo{k} {talk(30)} pair{k}@y.org", None) for j in range(2)]
    note = f"a note of zebrafish {talk(60)} copy@z.org"
    rows += [(len(rows) + k, f"{note} {k}", None) for k in range(9)]
    rows += [(len(rows) + k, talk(70), None) for k in range(1500)]
    df = docs(spark, rows)
    got = {r["term"]: r["share"] for r in pii.disclosing_terms(df, Workspace(spark, "pii-test")).collect()}
    want = plain_terms(rows)
    assert set(got) == set(want) and all(abs(got[w] - want[w]) < 1e-9 for w in want)
    assert {f"nick{k}" for k in range(8)} <= set(got) and not any(w.startswith(("memo", "zebra", "rare")) for w in got)
    clean = [r for r in rows if "@" not in r[1]]
    texts = {r["doc_id"]: r["text"] for r in pii.cleaned(spark, df, Workspace(spark, "pii-test")).collect()}
    assert sum(texts[d] == t for d, t, _ in clean) >= 0.99 * len(clean)


def test_general_forms():
    assert [pii.general(w) for w in ("1999", "A4", "Bob", "cave")] == ["[number]", "[code]", "[name]", "[word]"]
    assert pii.sanitised("ab cd ef", [("email", 3, 5)], [(0, 2, "r"), (6, 8, "g"), (3, 4, "g")]) == " [email] [word]"


# ---- language


def test_languages_are_told_apart(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(spark, table).join(table.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == table.count()
    assert (got["held_out"] == got["doc_id"].map(lambda d: zlib.crc32(str(d).encode()) % 4 == 2)).all()
    held = got[got["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.97 and got["score"].between(0, 1).all()


def test_what_has_no_letter_has_no_language(spark):
    rows = [(k, "the and of with here", "en") for k in range(8)] + [(20 + k, "der die und nicht auch", "de") for k in range(8)]
    rows += [(50, None, "en"), (51, "", "en"), (52, "12 + 3 !", None), (None, "und nicht", None), (53, "the " * 60000, None), (54, "漢字", None), (54, "漢字", None)]
    df = docs(spark, rows)
    got = [(r["doc_id"], r["lang_pred"]) for r in language.identify(spark, df).collect()]
    assert {d for d, p in got if p == "und"} == {50, 51, 52} and (None, "de") in got and (53, "en") in got and len(got) == len(rows)
    kept = language.accepted(spark, df, Workspace(spark, "lang-test"))
    assert kept.columns == df.columns and kept.count() == len(rows) - 3
    assert language.identify(spark, df.limit(0)).collect() == []
    assert {r["lang_pred"] for r in language.identify(spark, df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_texts_with_letters_stay_where_nothing_can_be_learnt(spark):
    held = [k for k in range(40) if language.held_out(k)]
    texts = {1: "some words", 2: "12 + 3", 3: None, 4: "", 5: "漢字"}
    df = docs(spark, [(d, t, None) for d, t in texts.items()])
    assert sorted(r["doc_id"] for r in language.accepted(spark, df, Workspace(spark, "lang-test")).collect()) == [1, 5]
    df = docs(spark, [(d, f"some words {d}", "en") for d in held])
    assert language.accepted(spark, df, Workspace(spark, "lang-test")).count() == len(held) > 0


def test_what_is_like_no_language_goes_and_clean_texts_stay(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang", "n_chars")
    rng = random.Random(8)
    letters = "qxzjkvwpfbyhgm"
    junk = [(10**9 + k, " ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 9))) for _ in range(300)), None, 1) for k in range(50)]
    junk += [(10**9 + 99, None, None, 1), (10**9 + 98, "1234 !", "en", 1)]
    df = table.unionByName(spark.createDataFrame(junk, table.schema)).withColumn("_size", F.lit("mine")).withColumn("_p", F.lit(7))
    kept = language.accepted(spark, df, Workspace(spark, "lang-test"))
    assert kept.columns == df.columns and kept.select("_size", "_p").distinct().collect() == [("mine", 7)]
    left = {r[0] for r in kept.select("doc_id").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    clean = {r[0] for r in labels.filter("quality = 1").select("doc_id").collect()}
    assert not {d for d in left if d >= 10**9} and clean <= left
    # What else goes is one word over and over.
    assert len(left) >= 0.99 * table.count()


def test_a_language_is_predicted_once_per_text(spark):
    plans = {}

    class Watched(Workspace):
        def store(self, df, name):
            plans[name] = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
            return super().store(df, name)

    df = docs(spark, [(k, "the and of with here", "en") for k in range(8)] + [(50, None, "en"), (51, "12", "en")])
    assert language.accepted(spark, df, Watched(spark, "lang-test")).count() == 8
    assert plans["predicted"].count("ArrowEvalPython") == 1


def test_many_languages_are_all_learnt(spark):
    rows = [(4 * k, " ".join(chr(0x4E00 + 3 * k + j) for j in range(3)), f"l{k:04d}") for k in range(1100)]
    rows = [r for r in rows if not language.held_out(r[0])]
    got = language.identify(spark, docs(spark, rows)).collect()
    names = {r[0]: r[2] for r in rows}
    assert len(names) > 800 and all(r["lang_pred"] == names[r["doc_id"]] for r in got)


def test_bundles_are_sums_of_bound_letters(monkeypatch):
    def slow(text):
        out = np.zeros(language.DIMENSIONS)
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            padded = f" {word} "
            for k in range(len(padded) - 2):
                a, b, c = (language.letter_vector(ord(x)).astype(int) for x in padded[k : k + 3])
                out += np.roll(a, 2) * np.roll(b, 1) * c
        return out

    texts = ["One two, THREE three", None, "x", "é漢" * 40, "many words " * 30, "42"]
    want = [slow(t or "") for t in texts]
    assert np.array_equal(language.Profiles().bundles(texts), want)
    monkeypatch.setattr(language, "GRAMS_KEPT", 5)
    monkeypatch.setattr(language, "WORDS_AT_ONCE", 3)
    assert np.array_equal(language.Profiles().bundles(texts), want)


# ---- quality


def plain_counts(text):
    words = [w for w in re.split("[ \t\n\v\f\r]+", text) if w]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    repeated = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    lines = [line for line in text.split("\n") if line.strip(" \t\n\v\f\r")]
    dup = sum(line in lines[:k] for k, line in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated)


def test_counts_equal_the_plain_ones(spark):
    rng = random.Random(8)
    rows = [(k, "".join(rng.choice(["a ", "b ", "c\n", "é#", "\t", "\x85", "<x> ", "a b c ", "\n"]) for _ in range(rng.randint(0, 120))), "en") for k in range(150)]
    rows += [(900, None, None), (901, "", None), (902, "w " * 50000, None), (903, "x" * 90000, "en"), (903, "x" * 90000, "en"), (None, "一二三 " * 60, None)]
    got = fertility.judge(spark, docs(spark, rows), Workspace(spark, "fertility-test")).toPandas()
    assert len(got) == len(rows)
    by_id = got.set_index(got["doc_id"].fillna(-1).astype(int))
    for doc_id, text, _ in rows:
        row = by_id.loc[[-1 if doc_id is None else doc_id]].iloc[0]
        want = plain_counts(text or "") if doc_id != 902 else (50000, 50000, 0, 0, 50000)
        assert tuple(row[c] for c in fertility.COUNTS) == want, doc_id
        assert row["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (row["base_failed"] and row["kept"])
    assert fertility.judge(spark, docs(spark, []), Workspace(spark, "fertility-test")).collect() == []


def test_bands_part_junk_from_prose(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = fertility.judge(spark, table, Workspace(spark, "fertility-test")).join(labels, "doc_id").filter("not base_failed").toPandas()
    assert got[got["quality"] == 1]["kept"].mean() > 0.99
    assert got[got["quality"] == 0]["kept"].mean() < 0.2


def test_scripts_count_every_letter():
    mixed = "".join("аb"[k % 2] for k in range(8000)) + "а" * 10  # one more of the Cyrillic ones
    assert fertility.script(mixed) == "cyrillic" and fertility.script(mixed[::-1]) == "cyrillic" and fertility.script("ab" + "а" * 2) == "cyrillic"
    assert fertility.script("1 2 _") == "none"


def test_endless_words_are_measured_whole():
    word = "".join(random.Random(1).choice("abcdefgh") for _ in range(600))
    assert fertility.measurer()(word)[0] == len(fertility.Measurer().units.encode([word])) and fertility.measurer()("x" * 300000) is not None


def test_scripts():
    assert [fertility.script(t) for t in ("abc", "абв г", "漢字", "12", "")] == ["latin", "cyrillic", "cjk", "none", "none"]
