"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A 3-gram binds its letters: the product of the first
letter's vector rotated twice, the second's rotated once and the third's. A text is the bundle (sum) of
its 3-grams, a language's prototype the bundle of its texts, and a text is of the language whose prototype
has the greatest cosine to it. Letter vectors are drawn from the code point alone, so every task has the
same without sharing them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendscape.llm import common
from lendscape.session import Workspace

DIMENSIONS = 1024
GRAMS_KEPT = 8_000
TABLE_STEP = 2048
WORDS_KEPT = 60_000
WORDS_AT_ONCE = 20_000
LONG_WORD = 64
DOCS_AT_ONCE = 64
UNKNOWN = "und"
# A document goes whose cosine is this many deviations below that of the labelled ones of its language and size.
DEVIATIONS = 6.0
LEAST_PEERS = 30
LETTERS = re.compile(r"[^\W\d_]+")


@cache
def letter_vector(code: int) -> np.ndarray:
    """Drawn from the code point; kept, as an alphabet is used over and over."""
    return np.random.default_rng(code).integers(0, 2, DIMENSIONS).astype(np.int8) * 2 - 1


def words(text: str | None) -> list[str]:
    """The lower-cased runs of letters."""
    return LETTERS.findall((text or "").lower())


class Profiles:
    """The 3-grams met so far: a place for each, and its vector there.

    The 3-grams of a word, with a gap before and after it, are looked up once and kept. When there are
    GRAMS_KEPT of them all is forgotten; a place is valid until then.
    """

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.of_word: dict[str, bytes] = {}
        self.table = np.zeros((TABLE_STEP, DIMENSIONS), np.float32)

    def full(self) -> bool:
        return len(self.place) > GRAMS_KEPT

    def _places(self, word: str) -> bytes:
        padded = f" {word} "
        out = []
        for gram in map("".join, zip(padded, padded[1:], padded[2:], strict=False)):
            at = self.place.get(gram)
            if at is None:
                at = self.place[gram] = len(self.place)
                if at >= len(self.table):
                    self.table = np.concatenate([self.table, np.zeros((TABLE_STEP, DIMENSIONS), np.float32)])
                a, b, c = (letter_vector(ord(x)) for x in gram)
                self.table[at] = np.roll(a, 2) * np.roll(b, 1) * c
            out.append(at)
        found = np.array(out, "<u4").tobytes()
        if len(word) <= LONG_WORD:
            if len(self.of_word) > WORDS_KEPT:
                self.of_word.clear()
            self.of_word[word] = found
        return found

    def counts(self, part: list[str]) -> np.ndarray:
        """How often each place occurs in some words."""
        known = self.of_word.get
        return np.bincount(np.frombuffer(b"".join([known(w) or self._places(w) for w in part]), "<u4"))

    def bundles(self, texts: list[str | None]) -> np.ndarray:
        """A row per text: the sum of its 3-grams' vectors, all zero without a letter."""
        out = np.zeros((len(texts), DIMENSIONS), np.float32)
        parts = [(k, w[at : at + WORDS_AT_ONCE]) for k, w in enumerate(map(words, texts)) for at in range(0, len(w), WORDS_AT_ONCE)]
        while parts:
            if self.full():
                self.forget()
            taken, parts = [], list(reversed(parts))
            while parts and len(taken) < DOCS_AT_ONCE and not self.full():
                k, part = parts.pop()
                taken.append((k, self.counts(part)))
            parts.reverse()
            used = len(self.place)
            matrix = np.zeros((len(taken), used), np.float32)
            for row, (_, n) in zip(matrix, taken, strict=True):
                row[: len(n)] = n
            np.add.at(out, [k for k, _ in taken], matrix @ self.table[:used])
        return out


@cache
def profiles() -> Profiles:
    """One per worker."""
    return Profiles()


def held_out(doc_id: int | None) -> bool:
    """A document is held out if crc32 of its id as text leaves 2 by 4; one without an id never is."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def prototypes(docs: DataFrame) -> list[tuple[str, np.ndarray]]:
    """A unit vector per language, learnt from all documents with a language that are not held out.

    Every text counts alike: by its 3-gram counts over their length. As bundling is a sum, a task adds
    the weights of its texts first and multiplies them with the 3-grams' vectors once; the sums of tasks
    are added up by (language, dimension) before anything reaches the driver, which gets DIMENSIONS whole
    numbers per language. However many languages there are, all are learnt; tasks hold 4 KB for each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        weights: dict[str, np.ndarray] = {}
        own = profiles()  # a worker runs one task at a time; whoever finds it full settles and forgets

        def settle() -> None:
            for lang, w in weights.items():
                for at in range(0, len(w), TABLE_STEP):  # in parts: doubles take twice the room of the table
                    part = w[at : at + TABLE_STEP]
                    sums[lang] = sums.get(lang, 0.0) + part @ own.table[at : at + len(part)].astype(np.float64)
            weights.clear()

        def add(lang: str, n: np.ndarray, scale: float) -> None:
            w = weights.get(lang, np.zeros(0))
            if len(w) < len(n):
                w = np.concatenate([w, np.zeros(len(n) - len(w))])
            w[: len(n)] += n * scale
            weights[lang] = w

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = words(text)
                for at in range(0, len(found), WORDS_AT_ONCE):
                    if own.full():
                        settle()
                        own.forget()
                    n = own.counts(found[at : at + WORDS_AT_ONCE])
                    add(lang, n, 1.0 / float(np.sqrt(np.square(n, dtype=np.float64).sum())))
        settle()
        if sums:
            flat = pa.array(np.rint(np.concatenate(list(sums.values())) * (1 << 20)).astype(np.int64))
            vectors = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, DIMENSIONS, dtype=np.int32), flat)
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), vectors], names=["lang", "vector"])

    known = docs.filter("lang is not null and text is not null")
    rest = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2) | F.col("doc_id").isNull()
    summed = known.filter(rest).select("text", "lang").mapInArrow(run, "lang string, vector array<long>")
    whole = summed.select("lang", F.posexplode("vector").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    listed = whole.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("v")).collect()
    out = []
    for row in sorted(listed, key=lambda r: r["lang"]):
        vector = np.array([p["x"] for p in row["v"]], np.float64)
        out.append((row["lang"], vector / max(float(np.linalg.norm(vector)), 1.0)))
    return out


def predictor(learnt: list[tuple[str, np.ndarray]]):
    """A column function of the text: ``lang_pred`` and ``score`` (the cosine, 0 where negative).

    ``und`` with score 0 if the text is null or has no letter, or nothing was learnt. Of equal cosines the
    first language in code-point order counts.
    """
    names = [lang for lang, _ in learnt]
    matrix = np.array([v for _, v in learnt], np.float32).reshape(len(learnt), DIMENSIONS)

    @F.pandas_udf("struct<lang_pred string, score double>")
    def predict(texts):
        import pandas as pd

        langs, scores = [], []
        for at in range(0, len(texts), DOCS_AT_ONCE):
            vectors = profiles().bundles(texts.iloc[at : at + DOCS_AT_ONCE].tolist())
            norms = np.linalg.norm(vectors, axis=1)
            if not names:
                norms[:] = 0
            cosines = vectors @ matrix.T / np.maximum(norms, 1e-9)[:, None]
            for norm, row in zip(norms, cosines, strict=True):
                best = int(np.argmax(row)) if norm else -1
                langs.append(names[best] if norm else UNKNOWN)
                scores.append(min(1.0, max(0.0, float(row[best]))) if norm else 0.0)
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    return predict


def identify(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score. Learns first, then predicts for every row.

    Rows without a doc_id are never held out; repeated rows are predicted each; other columns are ignored.
    """
    common.small_batches(spark)
    predict = predictor(prototypes(docs.select("doc_id", "text", "lang")))
    out = docs.select("doc_id", predict("text").alias("p"))
    rest = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return out.select("doc_id", rest.alias("held_out"), "p.lang_pred", "p.score")


def floors(scored: DataFrame) -> DataFrame:
    """Per language and size the least cosine that is still like the documents it was learnt from: lang_pred, size, floor.

    Sizes are powers of two, as short texts are less like any prototype. A class of few documents has no floor.
    """
    n, mean, spread = F.count("*"), F.avg("score"), F.stddev_pop("score")
    learnt = scored.filter("lang_pred = lang and not held_out")
    return learnt.groupBy("lang_pred", "size").agg((mean - DEVIATIONS * spread).alias("floor"), n.alias("n")).filter(F.col("n") >= LEAST_PEERS).drop("n")


def accepted(spark: SparkSession, docs: DataFrame, ws: Workspace) -> DataFrame:
    """The documents with a language. All columns stay as they are.

    Null texts go, those without a letter, and those whose cosine with the best language is below its ``floors``. Where nothing was
    learnt, as no text with a language could be learnt from, the letters alone decide.
    """
    common.small_batches(spark)
    learnt = prototypes(docs.select("doc_id", "text", "lang"))
    if not learnt:

        @F.pandas_udf("boolean")
        def lettered(texts):
            return texts.map(lambda text: LETTERS.search(text or "") is not None).astype(bool)

        return docs.filter(lettered("text"))
    # Called not deterministic, as the planner else repeats the prediction below the filter: twice the work, twice the workers.
    predict = predictor(learnt).asNondeterministic()
    p = common.fresh(docs, "_p")
    predicted = ws.store(docs.withColumn(p, predict("text")).filter(F.col(p)["lang_pred"] != UNKNOWN), "predicted")
    size = F.floor(F.log2(F.char_length("text") + 1)).cast("int")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    found = ws.store(floors(predicted.select(f"{p}.lang_pred", f"{p}.score", "lang", size.alias("size"), held.alias("held_out"))), "floors")
    names = {c: common.fresh(predicted, f"_{c}") for c in ("lang_pred", "size", "floor")}
    least = found.select(*[F.col(c).alias(n) for c, n in names.items()])
    judged = predicted.withColumn(names["lang_pred"], F.col(p)["lang_pred"]).withColumn(names["size"], size).join(least, [names["lang_pred"], names["size"]], "left")
    return judged.filter(F.col(p)["score"] >= F.coalesce(names["floor"], F.lit(0.0))).select(*docs.columns)
