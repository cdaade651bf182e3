"""Quality by tokeniser fertility: text that a public vocabulary cuts unlike its peers is not prose.

Three measures per document, over its words as the vocabulary encodes them: characters per token (letters
and digits, as marks and symbols cost tokens and say little), the share of byte-fallback tokens, and the
entropy of its tokens as a share of the most it could be. Peers are the documents of the same
language, or of the same script where none is given; the band of a measure reaches REACH times the distance
between the peers' quartiles beyond them, so up to a quarter of them may be junk without moving it, and
the spread of ordinary text is left alone.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendscape.llm import common
from lendscape.llm.tokens import UnitEncoder
from lendscape.session import Workspace

VOCABULARY = "piece_bpe_32k.model"
LEAST_WORDS = 50
MOST_REPEATED = 50
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
WORD_CHARACTERS = re.compile(r"[^\W_]+")
LETTER = re.compile(r"[^\W\d_]")
REACH = 2.5
# Bands reach this far at least: ordinary text differs by as much.
SLACK = {"chars_per_token": 0.25, "fallback_share": 0.05, "entropy": 0.2}
# What a measure of one token spreads by; over n tokens its square root of n-th part is added.
NOISE = {"chars_per_token": 1.3, "fallback_share": 0.2, "entropy": 0.5}
MEASURES = tuple(SLACK)


def dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return len(lines) - len(set(lines))


def repeat_words(words: list[bytes]) -> int:
    """Words in windows of three that occur twice or more, the first occurrence included."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    _, pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
    _, window, n = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    again = n[window] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : len(again) + k] |= again
    return int(covered.sum())


class Measurer:
    """Token counts of words by one public vocabulary."""

    def __init__(self, name: str = VOCABULARY):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        self.byte = np.array([model.is_byte(k) for k in range(model.vocab_size())])
        self.units = UnitEncoder(model.encode)

    def __call__(self, text: str) -> tuple[int, float, float, float] | None:
        """Tokens and measures; None without a token."""
        words = text.split()
        ids = self.units.encode(words)
        if not len(ids):
            return None
        n = np.bincount(ids)
        n = n[n > 0]
        share = n / len(ids)
        entropy = -float((share * np.log2(share)).sum()) / max(1.0, float(np.log2(min(len(ids), len(self.byte)))))
        characters = sum(map(len, WORD_CHARACTERS.findall(text)))
        return len(ids), characters / len(ids), float(self.byte[ids].mean()), entropy


@cache
def measurer(name: str = VOCABULARY) -> Measurer:
    """One per worker."""
    return Measurer(name)


@cache
def _script_of(letter: str) -> str:
    return unicodedata.name(letter, "none").split(" ")[0].split("-")[0].lower()


def script(text: str) -> str:
    """The script of most of the text's letters, of equal ones the first by name; ``none`` without letters."""
    found: Counter[str] = Counter()
    for character, n in Counter(text).items():
        if LETTER.match(character):
            found[_script_of(character)] += n
    return max(sorted(found), key=found.__getitem__, default="none")


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = "doc_id long, peers string, " + ", ".join(f"{c} long" for c in (*COUNTS, "n_tokens")) + ", " + ", ".join(f"{m} double" for m in MEASURES)


def measured(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Counts and measures per document, over the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = measurer(vocabulary)
        for batch in batches:
            rows = []
            for doc_id, text, lang in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                text = text or ""
                words = text.encode("utf-8", "replace").split()
                characters = len(text) - sum(map(text.count, SPACES))
                found = measure(text) or (0, None, None, None)
                peers = f"lang {lang}" if lang is not None else f"script {script(text)}"
                rows.append((doc_id, peers, len(words), characters, sum(map(text.count, SYMBOLS)), dup_lines(text), repeat_words(words), *found))
            kinds = [pa.int64(), pa.string(), *[pa.int64()] * 6, *[pa.float64()] * 3]
            columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "peers", *COUNTS, "n_tokens", *MEASURES])

    return docs.select(F.col("doc_id").cast("long"), "text", "lang").mapInArrow(run, SCHEMA)


def bands(rows: DataFrame) -> DataFrame:
    """Per language or script the least and greatest value kept of each measure, from all that pass the base rules."""
    ends = [F.percentile_approx(m, F.array(F.lit(0.25), F.lit(0.75)), 10_000).alias(m) for m in MEASURES]
    found = rows.filter("not base_failed").groupBy("peers").agg(*ends)
    out = []
    for m in MEASURES:
        low, high = F.col(m)[0], F.col(m)[1]
        room = F.greatest(REACH * (high - low), F.lit(SLACK[m]))
        out += [(low - room).alias(f"least_{m}"), (high + room).alias(f"most_{m}")]
    return found.select("peers", *out)


def judge(spark: SparkSession, docs: DataFrame, ws: Workspace) -> DataFrame:
    """Per document its counts, whether the base rules reject it, and whether it is kept.

    A null text has no words and fails. A document without tokens, or whose peers all fail, is judged by
    the base rules alone. Repeated rows are judged each; a null doc_id is kept as it is; a null lang falls
    back to the script. Other columns are ignored.
    """
    common.small_batches(spark)
    many = 100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")
    rows = measured(docs).withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | many)
    held = ws.store(rows, "measured")
    # Stored, so that its size is known: for a table of a few rows the documents need not be moved.
    joined = held.join(ws.store(bands(held), "bands"), "peers", "left")
    inside = F.lit(True)
    for m in MEASURES:
        noise = NOISE[m] / F.sqrt(F.greatest("n_tokens", F.lit(1)))
        inside = inside & F.coalesce(F.col(m).between(F.col(f"least_{m}") - noise, F.col(f"most_{m}") + noise), F.lit(True))
    return joined.withColumn("kept", ~F.col("base_failed") & inside)
