"""Personal data: patterns for what identifies by itself, co-occurrence for what gives it away.

The base finds e-mail addresses, IP addresses, card and phone numbers. Each distinct value is a protected
entity. How strongly a term reveals an entity is measured over the corpus, as pointwise mutual
information as a share of the entity's own information content: 1 if the entity is in every document of the
term, 0 if the term says nothing about it. What chance could have brought together is left out first, at a false
discovery rate over all pairs of a term and an entity. Terms at the generalising threshold or above are replaced by their
kind (a number, a code, a name, a word), those at the removing threshold or above disappear, wherever they occur.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lendscape.llm import common
from lendscape.session import Workspace

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
WORDS = re.compile(r"[^\W_]+")
# Of the pairs that count as evidence, the share that chance may have brought together.
CHANCE = 0.01
# Evidence is read off in steps of 1 / STEPS bits, up to MOST_BITS.
STEPS, MOST_BITS = 16, 1024
SHINGLE_WORDS = 5
GENERALISE, REMOVE = 0.8, 0.95
TERMS_HELD = 100_000
# Bits of the filter that a task asks before it hands a word on: their number is all that grows into a task.
FILTER_BITS = 1 << 23
# A task remembers the filter's answer for so many words of at most that length.
WORDS_KNOWN, LONGEST_KNOWN = 1 << 16, 64
SPAN_ROWS = pa.list_(pa.struct({"start": pa.int32(), "kind": pa.int32(), "end": pa.int32()}))
WORD_ROWS = pa.list_(pa.struct({"term": pa.string(), "start": pa.int32(), "end": pa.int32()}))

Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Starts from each @ and goes left, so a long run without one costs nothing."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = end + len(text[end:at].rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            end = domain.end()
        else:
            # What has been seen up to here cannot begin a match any more.
            end = max(end, at + 1)
        at = text.find("@", end)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(d - 9 if d > 9 else d for d in (2 * int(c) for c in digits[-2::-2]))) % 10 == 0


def _digits(found: str) -> str:
    return "".join(c for c in found if "0" <= c <= "9")


def base_spans(text: str | None) -> list[Span]:
    """Kind, start and end (code points, end exclusive), by start and then kind as listed.

    A match that fails its check is dropped; the search goes on behind it.
    """
    if not text:
        return []
    out = [("email", *s) for s in _emails(text)]
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (part.lstrip("0") for part in m[0].split("."))):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 10 <= len(_digits(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def entity(text: str, span: Span) -> str:
    """The value a span protects: case and punctuation do not make another."""
    kind, start, end = span
    found = text[start:end]
    return f"{kind} {found.lower() if kind == 'email' else found if kind == 'ip' else _digits(found)}"


def entities(text: str | None) -> set[str]:
    """What the base finds in a text."""
    return {entity(text, span) for span in base_spans(text)}


def terms_of(text: str) -> set[str]:
    """The words of a text that are not part of an entity."""
    taken = _covered(base_spans(text))
    words = (m for m in WORDS.finditer(text) if m.end() - m.start() > 1)
    return {m[0].lower() for m in words if not _inside(taken, m.start(), m.end())}


def _covered(spans: list[Span]) -> list[tuple[int, int]]:
    """Spans merged into disjoint stretches."""
    out: list[list[int]] = []
    for _, start, end in sorted(spans, key=lambda s: s[1]):
        if out and start < out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


def _inside(stretches: list[tuple[int, int]], start: int, end: int) -> bool:
    k = bisect_right(stretches, (start, 1 << 62)) - 1
    return (k >= 0 and stretches[k][1] > start) or (k + 1 < len(stretches) and stretches[k + 1][0] < end)


def _digest() -> Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("digest")


def witness(text: str) -> int:
    """The least hash of the text's five-word shingles: near copies mostly have the same, other texts hardly ever."""
    words = text.encode("utf-8", "replace").lower().split()
    runs = (b" ".join(s) for s in zip(*(words[k:] for k in range(SHINGLE_WORDS)), strict=False))
    least = min((xxhash.xxh64_intdigest(s, 1) for s in runs), default=xxhash.xxh64_intdigest(b" ".join(words), 1))
    return least - (1 << 63)


def _listed(docs: DataFrame, finder: Callable[[], Callable[[str], set[str]]], name: str) -> DataFrame:
    """A row per document (column ``digest``) and string found in its text, by what each task makes with ``finder``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = finder()
        for batch in batches:
            found_in = [list(found(text)) if text else [] for text in batch.column(1).to_pylist()]
            rows = np.repeat(np.arange(batch.num_rows), [len(x) for x in found_in])
            strings = pa.array([x for part in found_in for x in part], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), strings], names=["digest", name])

    return docs.select(_digest(), "text").mapInArrow(run, f"digest binary, {name} string")


def _witnessed(texts: DataFrame) -> DataFrame:
    """digest and ``witness`` of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([witness(t or "") for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["digest", "witness"])

    return texts.select("digest", "text").mapInArrow(run, "digest binary, witness long")


def together(docs: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame, int]:
    """How many documents hold each entity (``n_entity``); each entity with a term anywhere in the document (``n_both``; ``texts``
    counts copies and near copies once); and the number of all such pairs.

    Left out of the pairs is only what one text alone holds: by ``evidence`` it proves nothing.
    """
    mentions = ws.store(_listed(docs, lambda: entities, "entity").groupBy("digest", "entity").agg(F.count("*").alias("n")), "mentions")
    alone = mentions.groupBy("entity").agg(F.sum("n").alias("n_entity"), F.count("*").alias("texts")).filter("texts > 1")
    alone = ws.store(alone.drop("texts"), "entities")
    held = ws.store(mentions.join(alone, "entity").select("digest", "entity", "n"), "held")
    # Few texts hold an entity: the others do not travel.
    asked = common.perhaps_in(docs.select(_digest(), "text"), held, "digest", "asked").filter("asked").drop("asked")
    texts = asked.join(held.select("digest").distinct(), "digest", "left_semi").dropDuplicates(["digest"])
    texts = ws.store(texts, "texts")
    words = _listed(texts.select("text"), lambda: terms_of, "term").join(_witnessed(texts), "digest")
    met = held.join(words, "digest").groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count_distinct("witness").alias("texts"))
    asked = Observation()
    pairs = ws.store(met.observe(asked, F.count("*").alias("n")).filter("texts > 1"), "pairs")
    return alone, pairs, asked.get["n"]


def evidence() -> Column:
    """Bits by which chance is ruled out as the reason why a term and an entity occur together (Chernoff's bound).

    The first text makes one ask, the others answer: of the ``texts`` that hold both and the documents that hold the term
    alone, all but one are trials, each with the entity at its share of all documents if the term says nothing about it.
    """
    hits = (F.col("texts") - 1).cast("double")
    trials = hits + F.col("n_term") - F.col("n_both")
    rate, chance = hits / trials, F.col("n_entity") / F.col("n_docs")
    missed = F.when(rate < 1, (1 - rate) * F.log2(F.try_divide(1 - rate, 1 - chance))).otherwise(0.0)
    return F.when(rate > chance, trials * (rate * F.log2(rate / chance) + missed)).otherwise(0.0)


def enough(pairs: DataFrame, asked: int) -> float:
    """The least evidence at which, of the pairs that have it, chance explains no more than the share CHANCE.

    Benjamini and Hochberg's rule over all ``asked`` pairs, read off a histogram of the evidence of bounded size.
    """
    step = F.floor(F.col("bits") * STEPS)
    counted = sorted(((r.step, r.n) for r in pairs.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, passed = math.inf, 0
    for at, n in counted:
        passed += n
        if math.log2(asked / (CHANCE * passed)) <= at / STEPS:
            least = at / STEPS
    return least


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """How many documents each of some terms occurs in, over the whole corpus.

    A task counts up to TERMS_HELD terms before it hands them on, so what is shuffled is far smaller than
    the words, and a worker never holds more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def sent() -> pa.RecordBatch:
            names, counts = list(held), list(held.values())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], names=["term", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update({w for w in WORDS.findall((text or "").lower()) if len(w) > 1})
                if len(held) > TERMS_HELD:
                    yield sent()
        yield sent()

    return docs.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term")).join(terms, "term", "left_semi")


def disclosing_terms(docs: DataFrame, ws: Workspace) -> DataFrame:
    """Terms that give a protected entity away: term and the strongest ``share`` of an entity's information.

    Counts are of documents, all of them. Rare entities and pairs are judged like any other: a pair counts if its
    evidence is ``enough`` for the number of pairs there are, by different texts, so copies of one text prove nothing.
    """
    alone, pairs, asked = together(docs, ws)
    counted = term_counts(docs, pairs.select("term").distinct())
    all_docs = docs.agg(F.count("*").alias("n_docs"))
    joined = pairs.join(alone, "entity").join(counted, "term").withColumn("n_docs", all_docs.scalar())
    joined = ws.store(joined.withColumn("bits", F.least(evidence(), F.lit(float(MOST_BITS)))), "evidence")
    joined = joined.filter(F.col("bits") >= enough(joined, asked))
    own = F.log2(F.col("n_docs") / F.col("n_entity"))
    mutual = F.log2(F.col("n_both") * F.col("n_docs") / F.col("n_entity") / F.col("n_term"))
    share = joined.withColumn("share", F.try_divide(mutual, own)).filter(F.col("share") >= GENERALISE)
    return share.groupBy("term").agg(F.max("share").alias("share"))


def general(term: str) -> str:
    """What is left of a generalised term."""
    if term.isdigit():
        return "[number]"
    if not term.isalpha():
        return "[code]"
    return "[name]" if term[:1].isupper() else "[word]"


def _places(term: str, size: int) -> tuple[int, int]:
    found = xxhash.xxh64_intdigest(term.encode("utf-8", "replace"), 2)
    return found % size, (found >> 32) % size


def _filter(terms: DataFrame, size: int) -> np.ndarray:
    """Bits that say of a word that it may be a term. Of fixed size, the only thing that reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: set[int] = set()
        for batch in batches:
            for term in batch.column(0).to_pylist():
                places.update(_places(term, size))
        words = pa.array([p >> 5 for p in places], pa.int32())
        yield pa.RecordBatch.from_arrays([words, pa.array([1 << (p & 31) for p in places], pa.int64())], names=["at", "bits"])

    table = np.zeros(size >> 5, np.int64)
    for row in terms.select("term").mapInArrow(run, "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toLocalIterator():
        table[row["at"]] = row.bits
    return table.astype(np.uint32)


def _passing(passes: np.ndarray, size: int) -> Callable[[str], set[str]]:
    """The distinct words of a text, lower-cased, that pass the filter."""

    def asked(word: str) -> bool:
        return all(passes[p >> 5] >> (p & 31) & 1 for p in _places(word, size))

    known = lru_cache(WORDS_KNOWN)(asked)

    def maybe(text: str) -> set[str]:
        words = {w for w in WORDS.findall(text.lower()) if len(w) > 1}
        return {w for w in words if (known if len(w) <= LONGEST_KNOWN else asked)(w)}

    return maybe


def with_marks(docs: DataFrame, terms: DataFrame, ws: Workspace, name: str, size: int = FILTER_BITS) -> DataFrame:
    """Adds to the documents the terms in their texts, as a map from term to share; null without any. One pass, however many terms.

    A task hands on the words that pass the filter, once per text; the table of terms decides on them.
    """
    passes = _filter(terms, size)

    listed = _listed(docs, lambda: _passing(passes, size), "term").distinct().join(terms, "term")
    held = F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias(name)
    key = common.fresh(docs, "_digest")
    hits = ws.store(listed.groupBy(F.col("digest").alias(key)).agg(held), "marks")
    # Texts without a term do not travel.
    asked = common.fresh(docs, "_asked")
    named = common.perhaps_in(docs.withColumn(key, _digest()), hits, key, asked)
    marked = named.filter(asked).join(hits, key, "left").select(*docs.columns, name)
    return marked.unionByName(named.filter(~F.col(asked)).select(*docs.columns, F.lit(None).cast(hits.schema[name].dataType).alias(name)))


def _scanned(docs: DataFrame, passes: np.ndarray, size: int) -> DataFrame:
    """doc_id with what its text shows by itself: counts and digest of the base, its spans, and the words that may be terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_in = _passing(passes, size)
        for batch in batches:
            counts, digests, found, maybe = [], [], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                stretches, words = _covered(base), words_in(text)
                hits = ((m[0].lower(), *m.span()) for m in WORDS.finditer(text)) if words else ()
                counts.append(Counter(k for k, _, _ in base))
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                found.append([{"start": s, "kind": KINDS.index(k), "end": e} for k, s, e in base])
                maybe.append([{"term": w, "start": s, "end": e} for w, s, e in hits if w in words and not _inside(stretches, s, e)])
            columns = [batch.column(0), *(pa.array([c[k] for c in counts], pa.int64()) for k in KINDS), pa.array(digests, pa.string())]
            columns += [pa.array(found, SPAN_ROWS), pa.array(maybe, WORD_ROWS)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kept = T.StructType([docs.schema["doc_id"], *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS)])
    spans = "array<struct<start:int,kind:int,end:int>>"
    words = "array<struct<term:string,start:int,end:int>>"
    kept = kept.add("base_sha256", "string").add("found", T.DataType.fromDDL(spans)).add("maybe", T.DataType.fromDDL(words))
    names = kept.names
    return docs.select("doc_id", "text").mapInArrow(run, kept)


def sanitised(text: str, base: list[Span], marks: list[tuple[int, int, str]]) -> str:
    """Base spans become their kind in brackets, terms become general or disappear."""
    out, at = [], 0
    cuts = [(start, end, f"[{kind}]") for kind, start, end in base]
    cuts += [(start, end, "" if how == "r" else general(text[start:end])) for start, end, how in marks]
    for start, end, instead in sorted(cuts, key=lambda c: (c[0], -c[1])):
        if start >= at:
            out += [text[at:start], instead]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, clean_text string"


def with_findings(docs: DataFrame, terms: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """Adds a struct ``name``: counts, the digest of the base spans, all spans, the sanitised text.

    ``clean_text`` is null where nothing was found. A term inside a base span is part of that span.
    """
    fields = [c.split()[0] for c in FOUND.split(", ")]

    @F.pandas_udf(FOUND)
    def scan(texts, marks):
        import pandas as pd

        rows = []
        for text, marked in zip(texts, marks, strict=True):
            text = text or ""
            base = base_spans(text)
            stretches = _covered(base)
            words = WORDS.finditer(text) if marked else ()
            shares = dict(marked or ())
            hits = ((m, shares.get(m[0].lower())) for m in words)
            places = [(m.start(), m.end(), "r" if share >= REMOVE else "g") for m, share in hits if share is not None]
            free = [x for x in places if not _inside(stretches, x[0], x[1])]
            kinds = Counter(k for k, _, _ in base)
            every = sorted([*base, *((TERM, s, e) for s, e, _ in free)], key=lambda s: (s[1], (*KINDS, TERM).index(s[0]), s[2]))
            digest = hashlib.sha256(_joined(base).encode()).hexdigest()
            rows.append((*(kinds[k] for k in KINDS), digest, _joined(every), sanitised(text, base, free) if every else None))
        return pd.DataFrame(rows, columns=fields)

    marks = common.fresh(docs, "_marks")
    marked = with_marks(docs, terms, ws, marks)
    return marked.select(*docs.columns, scan("text", marks).alias(name))


def find(spark: SparkSession, docs: DataFrame, ws: Workspace) -> DataFrame:
    """Per document: doc_id, counts per kind, base_sha256, spans.

    A null text is empty. Repeated rows are searched each; a null doc_id is kept. Other columns are ignored.
    """
    common.small_batches(spark)
    terms = ws.store(disclosing_terms(docs, ws), "terms")
    scanned = _scanned(docs, _filter(terms, FILTER_BITS), FILTER_BITS)
    # Stored, so that a row has one number. Texts do not travel: the words that may be terms do, and bring back where they stand.
    rows = ws.store(scanned.withColumn("row", F.monotonically_increasing_id()), "scanned")
    words = rows.select("row", F.explode("maybe").alias("m")).select("row", "m.*")
    place = F.struct("start", F.lit(len(KINDS)).alias("kind"), "end")
    hits = words.join(terms, "term").groupBy("row").agg(F.collect_list(place).alias("hits"))
    asking = F.size("maybe") > 0
    marked = rows.filter(asking).join(hits, "row", "left").withColumn("found", F.concat("found", F.coalesce("hits", F.array())))
    every = marked.select(*rows.columns).union(rows.filter(~asking))
    names = F.array(*(F.lit(k) for k in (*KINDS, TERM)))
    written = F.transform(F.array_sort("found"), lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string")))
    return every.select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", F.array_join(written, ",").alias("spans"))


def cleaned(spark: SparkSession, docs: DataFrame, ws: Workspace) -> DataFrame:
    """The documents with personal data and disclosing terms taken out of their texts; a null text stays null.

    ``n_chars`` follows the new text where the table has that column.
    """
    common.small_batches(spark)
    terms = ws.store(disclosing_terms(docs, ws), "terms")
    name = common.fresh(docs, "_f")
    clean = F.col(name)["clean_text"]
    out = {"text": F.coalesce(clean, "text").alias("text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out["n_chars"] = F.when(clean.isNotNull(), F.char_length(clean).cast(kind)).otherwise(F.col("n_chars")).alias("n_chars")
    return with_findings(docs, terms, ws, name).select(*[out.get(c, F.col(c)) for c in docs.columns])
