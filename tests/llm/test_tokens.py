import random
import re
import zlib

import numpy as np

from lendscape.llm import packing, token_ids, tokens
from lendscape.session import Workspace

ODD = "ab'SµÀÿ½² Z'\n\t\r \x0b\x0c.,!9é́ßİΣσ漢  　\x1c\x85​﻿<|endoftext|>😀s'tİ"
SCHEMA = "doc_id long, text string, start string, piece string"
TEXTS = [
    (4, "The quick brown fox, isn't it?  Twice.\n\nNew line"), (2, None), (9, ""), (7, "Straße é " * 400), (3, "word " * 6000),
    (3, "word " * 6000), (None, "no id"), (11, "x" * 30000), (12, "a<|endoftext|>b"), (13, " lead and trail \t\n"),
]


def test_units_give_what_whole_texts_give():
    rng = random.Random(5)
    samples = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + [t for _, t in TEXTS if t]
    for encoder in (tokens.byte_encoder(), tokens.word_encoder()):
        for text in samples:
            assert list(encoder(text)) == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text[:50]


def test_forgetting_units_changes_nothing():
    def encode(piece):
        return [len(piece), ord(piece[0])]

    encoder = tokens.UnitEncoder(encode, kept=3)
    for text in ("a b c d a", "b e f g h", "a a b", "i j k l m n", "a b c"):
        want = [x for u in text.split() for x in (len(u), ord(u[0]))]
        assert encoder.encode(text.split()).tolist() == want
    assert encoder.encode([]).tolist() == []
    parted = tokens.UnitEncoder(encode, lambda unit: [unit[:1], unit[1:]] if unit[1:] else [unit], kept=3)
    for text in ("ab bc a", "ab cd ef gh ij kl ab", "a b c d e f ab"):
        want = [x for u in text.split() for p in (u[:1], u[1:]) if p for x in (len(p), ord(p[0]))]
        assert parted.encode(text.split()).tolist() == want


def test_pieces_kept_among_units():
    asked = []

    def encode(piece):
        asked.append(piece)
        return [len(piece), ord(piece[0])]

    encoder = tokens.UnitEncoder(encode, tokens.WORD_PIECES.findall, kept=100, units=True)
    got = encoder.encode(["word,", "word", "(word)", ",", "it's", "'s", "12"]).tolist()
    parts = ["word", ",", "word", "(", "word", ")", ",", "it", "'s", "'s", "1", "2"]
    assert got == [x for p in parts for x in (len(p), ord(p[0]))]
    assert sorted(asked) == sorted(set(parts))
    rng = random.Random(6)
    small = tokens.WordEncoder(tokens.public_tokenizers.path("word_bpe_49k.json"), kept=4)
    for _ in range(2000):
        text = "".join(rng.choice("ab'sreDLl'' 12.,-_½é²\x01\x7f~$\"()\n\t") for _ in range(rng.randrange(30)))
        assert list(small(text)) == small.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_spaced_pieces_kept_among_units():
    encoder, asked = tokens.ByteEncoder(tokens.public_tokenizers.path("byte_bpe_50k.json"), kept=1000), []
    find = encoder.latin.pieces.find
    encoder.latin.pieces.find = lambda piece: asked.append(piece) or find(piece)
    for text in ("word, word (word) word's", "word\nword word. , it's", "\n\nword \nword\n\n"):
        assert list(encoder(text)) == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text
    assert len(asked) == len(set(asked))
    encoder("alone (alone)")
    assert {"\0alone", "(", "\0)"} <= set(encoder.latin.young)
    rng = random.Random(7)
    small = tokens.ByteEncoder(tokens.public_tokenizers.path("byte_bpe_50k.json"), kept=4)
    for _ in range(3000):
        text = "".join(rng.choice("ab'sreDLl''  12.,-_½éª²\x01\x7f~$\"()\n\t\r") for _ in range(rng.randrange(30)))
        assert list(small(text)) == small.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_shards_hold_what_was_put_in(monkeypatch):
    rng = np.random.default_rng(2)
    ids = [rng.integers(0, 300 if k % 2 else 1 << 20, rng.integers(0, 900)).astype(np.uint32) for k in range(60)] + [np.zeros(0, np.uint32)]
    names = [None, *range(59), -5]
    for at_once in (1, 1000, 1 << 20):
        monkeypatch.setattr(token_ids, "DECODE_AT_ONCE", at_once)
        back = list(token_ids.from_shard(token_ids.to_shard(names, ids)))
        assert [d for d, _ in back] == names and all(np.array_equal(a, b) for (_, a), b in zip(back, ids, strict=True))
    assert list(token_ids.from_shard(token_ids.to_shard([], []))) == []
    wide = np.array([0, 255, 256, 65535, 65536, (1 << 24) - 1, 1 << 24, (1 << 32) - 1], np.uint32)
    assert np.array_equal(token_ids.unpack(*token_ids.pack(wide)), wide)


def ids_of(text, encoder, end):
    return np.array([*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_token_ids_round_trip(spark):
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in TEXTS], SCHEMA)
    want, start = [], 0
    for doc_id, text in sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = ids_of(text, tokens.byte_encoder(), token_ids.END_ID)
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = [tuple(r) for r in token_ids.round_trip(spark, df, Workspace(spark, "ids-test")).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    assert token_ids.round_trip(spark, df.limit(0), Workspace(spark, "ids-test")).collect() == []


def test_small_shards_read_back_in_order(spark):
    df = spark.createDataFrame([(k, f"text {k} " * (k % 7 + 1)) for k in range(300)], "doc_id long, text string")
    ws = Workspace(spark, "ids-test")
    manifest = ws.store(token_ids.write_shards(df, ws.folder("s"), 3, shard_ids=200), "m")
    assert manifest.count() > 10
    got = sorted(tuple(r) for r in token_ids.read_shards(manifest, 3).collect())
    start = 0
    for doc_id, at, n, _ in got:
        assert at == start, doc_id
        start += n


def test_best_fit_never_overfills_and_bounds_never_exceed():
    rng = np.random.default_rng(4)
    for lengths in (rng.integers(1, 2049, 500), rng.integers(600, 1100, 300), np.full(100, 1025), np.full(64, 512), np.zeros(0, np.int64), np.array([2048])):
        bins, offsets, free = packing.best_fit_decreasing(lengths)
        used = np.bincount(bins, lengths, minlength=len(free)) if len(lengths) else np.zeros(0)
        assert (used + np.array(free) == 2048).all() if len(lengths) else free == []
        for b in range(len(free)):
            own = sorted(zip(offsets[bins == b], lengths[bins == b], strict=True))
            assert own[0][0] == 0 and all(x[0] + x[1] == y[0] for x, y in zip(own, own[1:], strict=False))
        assert packing.lower_bound(lengths) <= len(free)
    assert packing.lower_bound(np.full(100, 1025)) == 100 and packing.lower_bound(np.full(64, 512)) == 16
    assert packing.lower_bound(np.array([700] * 6)) == 3  # three of them do not fit together


def test_packing_holds_every_piece_once(spark):
    rows = [*TEXTS, *((100 + k, "some words here " * (k % 50 + 1)) for k in range(300))]
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)
    got = packing.pack(spark, df, Workspace(spark, "pack-test")).toPandas()
    want = []
    for doc_id, text in rows:
        ids = ids_of(text, tokens.word_encoder(), packing.END_ID)
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want.append((-1 if doc_id is None else doc_id, k, at, len(part), zlib.crc32(part.tobytes())))
    found = got.fillna(-1)[["doc_id", "piece", "start", "length", "ids_crc32"]].astype("int64")
    assert sorted(map(tuple, found.values.tolist())) == sorted(want)
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]] and own["length"].sum() <= 2048
    assert got["sequence_id"].nunique() <= got["length"].sum() / 2048 * 1.05 + 1
    assert packing.pack(spark, df.limit(0), Workspace(spark, "pack-test")).collect() == []


def test_groups_with_a_gap_exchange(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 20)
    monkeypatch.setattr(packing, "pieces", lambda df: df)
    rng = np.random.default_rng(6)
    rows = [(k, 0, 0, int(n), 0) for k, n in enumerate(rng.integers(300, 1400, 400))]
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(spark, df, Workspace(spark, "pack-test")).toPandas()
    assert sorted(got["doc_id"]) == list(range(400))
    assert (got.groupby("sequence_id")["length"].sum() <= 2048).all()
    alone = sum(len(packing.best_fit_decreasing(np.array([r[3] for r in rows[k : k + 20]]))[2]) for k in range(0, 400, 20))
    assert got["sequence_id"].nunique() < alone


def test_odd_and_crowded_texts_are_those_of_the_patterns():
    rng = random.Random(5)
    white = re.compile(r"\s ")
    for _ in range(20_000):
        text = "".join(rng.choice("ab <|\t\n\r\x0b\x0c\x00\x1c\x1f\x85\xa0é\u2003\u200b\ufeff漢") for _ in range(rng.randint(0, 6)))
        odd = tokens.odd(text, tokens.in_latin(text))
        assert odd == ("<|" in text or tokens.ODD.search(text) is not None)
        assert odd or tokens.crowded(text) == (white.search(text) is not None)
