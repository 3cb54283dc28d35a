import random
import zlib

import numpy as np
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from freightlens.llm import packing
from freightlens.llm.queries import TOKENIZER, packed
from freightlens.session import stage


def best_fit_one_by_one(counts, capacity):
    bins = []
    for w in sorted((w for w, n in counts.items() for _ in range(n)), reverse=True):
        fits = [i for i, room in enumerate(bins) if room >= w]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= w
        else:
            bins.append(capacity - w)
    return sorted(bins)


def fewest(items, capacity):
    """Exact, for a few items."""
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] >= items[i]:
                go(i + 1, bins[:b] + [bins[b] - items[i]] + bins[b + 1 :])
        go(i + 1, bins + [capacity - items[i]])

    go(0, [])
    return best[0]


histograms = st.dictionaries(st.integers(1, 30), st.integers(1, 5), max_size=12)


@settings(max_examples=300, deadline=None)
@given(histograms)
def test_grouped_best_fit_equals_one_by_one(counts):
    rooms = [30 - sum(w * k for w, k in content) for n, content in packing.best_fit(counts, 30) for _ in range(n)]
    assert sorted(rooms) == best_fit_one_by_one(counts, 30)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_reduction_keeps_an_optimal_packing(items):
    counts = {w: items.count(w) for w in set(items)}
    fixed, left = packing.reduce_instance(counts, 20)
    assert all(sum(w * k for w, k in c) <= 20 and n > 0 for n, c in fixed)
    total = {}
    for n, c in [*fixed, *((n, ((w, 1),)) for w, n in left.items())]:
        for w, k in c:
            total[w] = total.get(w, 0) + n * k
    assert total == counts
    rest = [w for w, n in left.items() for _ in range(n)]
    assert sum(n for n, _ in fixed) + fewest(rest, 20) == fewest(items, 20)


def test_whole_packing_and_slots():
    r = random.Random(4)
    for _ in range(50):
        counts = {r.randint(1, 100): r.randint(1, 50) for _ in range(40)}
        patterns = packing.pack_histogram(counts, 100)
        assert sum(n for n, _ in patterns) <= len(best_fit_one_by_one(counts, 100)) + 1
        ranks = {}
        for w, low, high, *_ in packing.slot_table(patterns):
            ranks.setdefault(w, []).append((low, high))
        assert {w: [*sorted(x)][-1][1] for w, x in ranks.items()} == counts
    assert packing.pack_histogram({}, 10) == []
    with pytest.raises(ValueError, match="capacity"):
        packing.pack_histogram({11: 1}, 10)


HOSTILE = ["", "  ", "Hello, world! it's we'll o'clock", "İstanbul ΣΑΣ", "a<|endoftext|>b", "日本語 テスト", "é e\u0301", "x\u00a0y\u0085z", "Ĳ ½²", "''s 't", "\t\r\n", "ŉ ǅ ß ẞ", "a\u200bb", "😀 ok"]


def test_ids_equal_the_tokenizer(spark, sf):
    texts = HOSTILE + [r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    plain = tokenizers.Tokenizer.from_file(TOKENIZER).encode_batch(texts, add_special_tokens=False)
    encoder = packing.Encoder(TOKENIZER)
    for start in range(0, len(texts), 37):
        for got, want in zip(encoder.encode(texts[start : start + 37]), plain[start : start + 37]):
            assert got.tolist() == want.ids


def check_placed(rows, capacity):
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_rows(spark, make_docs):
    long = "word, " * 3000
    docs = make_docs([(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "x"), (4, long)]).withColumns({"length": F.lit(1), "sequence_id": F.lit(2)})
    rows = packed(docs).collect()
    assert check_placed(rows, 2048) == 3
    ids = [*tokenizers.Tokenizer.from_file(TOKENIZER).encode(long, add_special_tokens=False).ids, 0]
    parts = sorted((r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == 4)
    assert parts == [(s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes())) for s in range(0, len(ids), 2048)]
    assert packed(make_docs([])).count() == 0


def test_query_and_sequences(spark, sf):
    from freightlens.llm.queries import QUERIES

    rows = QUERIES["op9_best_fit_packing"](spark, sf).collect()
    used = check_placed(rows, 2048)
    counts = {}
    for r in rows:
        counts[r["length"]] = counts.get(r["length"], 0) + 1
    assert used <= len(best_fit_one_by_one(counts, 2048))
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 40")
    tokens = stage(packing.pieces(docs, TOKENIZER))
    placed = packing.place(tokens.drop("ids"), ["doc_id", "piece"])
    where = {(r["doc_id"], r["piece"]): (r["sequence_id"], r["offset"]) for r in placed.collect()}
    whole = {r["sequence_id"]: r for r in packing.sequences(tokens, placed).collect()}
    for r in tokens.collect():
        seq, offset = where[r["doc_id"], r["piece"]]
        assert whole[seq]["ids"][offset : offset + r["length"]] == r["ids"]
    assert all(sum(r["lengths"]) == len(r["ids"]) for r in whole.values())


def test_words_with_signs_and_reused_encoders():
    """Signs behind words, runs of signs, contractions and digits; the same encoder again after it was emptied."""
    path = "/opt/tokenizers/word_bpe_49k.json"
    texts = ["it's. 's 've' don't), a.b.c ,, .,! x1. x. été. ß, ,x", "word$$$ ’s it’s, ab… ½. a½, word word$$$", "", "...'s ...'st x'. x'' x.'s",
             "aa(bb) [cc], {dd}; <ee> <|x|> <| endoftext", "Word, WORD, word, words"]
    for _ in range(2):
        encoder = packing.encoder_of(path)
        assert encoder.plain is not None and packing.encoder_of(path) is encoder
        want = [e.ids for e in encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        assert [list(x) for x in encoder.encode(texts)] == want
        assert [list(x) for x in encoder.encode(texts[::-1])] == want[::-1]
