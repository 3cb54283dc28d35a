import random
from itertools import combinations

import xxhash
from pyspark.sql import functions as F

from freightlens.llm import simhash
from freightlens.llm.components import connect


def brute(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def print_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(len(words) - 3, 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def test_triples_meet_every_four_positions():
    triples = simhash.position_triples()
    assert len(triples) == 20
    assert all(any(set(t) <= set(four) for t in triples) for four in combinations(range(8), 4))


def test_components_of_paths_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 40)] + [(5000 + i, 5000 + (i + 1) % 9) for i in range(9)] + [(7, 7), (-3, 60)]
    random.Random(1).shuffle(links)
    frame = spark.createDataFrame(links + [(None, 4)], "a long, b long")
    got = {r["node"]: r["root"] for r in connect(frame).collect()}
    want = {k: v for k, v in brute([x for x in links if x[0] != x[1]]).items()}
    assert got == want
    assert connect(frame.limit(0)).count() == 0


def test_links_are_complete_also_where_lists_are_long(spark):
    r = random.Random(2)
    centres = [r.getrandbits(64) for _ in range(4)]
    prints = {c ^ sum(1 << b for b in r.sample(range(64), r.randrange(0, 6))) for c in centres for _ in range(120)} | {r.getrandbits(64) for _ in range(50)} | {0}
    frame = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    near = [(min(signed(a), signed(b)), max(signed(a), signed(b))) for a, b in combinations(prints, 2) if (a ^ b).bit_count() <= 4]
    for long_list in (2, 10, 10_000):
        found = simhash.spanning_links(frame, long_list)
        assert {r["node"]: r["root"] for r in connect(found).collect()} == brute(near)


def test_a_dense_group_is_not_paired(spark):
    """2,000 fingerprints of at most two bits: two million links, all of them connected by stars."""
    prints = [0] + [1 << a for a in range(64)] + [1 << a | 1 << b for a, b in combinations(range(64), 2)]
    found = simhash.spanning_links(spark.createDataFrame([(signed(p),) for p in prints[:2000]], "fp long"))
    assert found.count() < 20_000
    assert len({r["root"] for r in connect(found).collect()}) == 1


def test_rows(spark, make_docs):
    texts = ["One two three four five six", "one TWO three\tfour five  six", "", None, "   ", "...", "Ünïcode ÀÉ words are kept as they are", "a b", "x " * 3000]
    rows = [(i * 10, t) for i, t in enumerate(texts)] + [(5, texts[0]), (None, texts[0]), (30, None)]
    got = simhash.near_duplicates(make_docs(rows)).collect()
    assert len(got) == len(rows)
    prints = {(k, t): print_of(t) for k, t in rows}
    for row in got:
        assert any(k == row["doc_id"] and signed(p) == row["fingerprint"] for (k, _), p in prints.items())
    classes = {r["doc_id"]: r["component_id"] for r in got}
    assert classes[0] == classes[10] == classes[5] == classes[None] == 0
    assert classes[20] == classes[30] == classes[40] == 20
    kept = simhash.keep_one(make_docs(rows)).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted(set(classes.values()))
    assert sum(r["doc_id"] is None for r in kept) == 1
    extra = simhash.keep_one(make_docs(rows).withColumns({"_kept": F.lit(1), "_place": F.lit(2)}))
    assert extra.columns[-2:] == ["_kept", "_place"] and extra.count() == len(kept)
    assert simhash.near_duplicates(make_docs([])).count() == 0 and simhash.keep_one(make_docs([])).count() == 0


def test_query_against_all_pairs(spark, sf):
    from freightlens.llm.queries import QUERIES

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {k: print_of(t) for k, t in texts.items()}
    pairs = [(a, b) for a, b in combinations(sorted(prints), 2) if (prints[a] ^ prints[b]).bit_count() <= 4]
    roots = brute(pairs)
    rows = QUERIES["op6_simhash_near_duplicates"](spark, sf).collect()
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows} == {(k, f"{p:016x}", roots.get(k, k)) for k, p in prints.items()}
    assert pairs
