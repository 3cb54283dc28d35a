import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from freightlens.llm import exact

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(rows):
    held = defaultdict(list)
    for key, text, *_ in rows:
        held[(text or "").translate(LOWER)].append(key)
    best = {t: max((k for k in ks if k is not None), default=None) for t, ks in held.items()}
    return sorted(((k, best[low], len(held[low]), hashlib.sha256(low.encode()).hexdigest()) for k, t, *_ in rows for low in [(t or "").translate(LOWER)]), key=repr)


def got(frame):
    return sorted(((r["id"], r["keep"], r["size"], r["digest"]) for r in frame.collect()), key=repr)


def sample():
    r = random.Random(5)
    texts = ["Hot TEXT ", "hot text", "hot text ", "", None, "ÄÖÜ Straße", "äÖÜ straße", "ÄÖÜ STRAßE", "İ", "i̇", "I", "x" * 300_000, "X" * 300_000, "\x00a", "\x00A", "a\nb"]
    rows = [(i, r.choice(texts)) for i in range(300)] + [(1000 + i, f"only {i}") for i in range(60)]
    rows += [(2000 + i, "Hot text ") for i in range(200)] + [(7, "hot text"), (7, "hot text"), (None, "hot text"), (None, "no key"), (None, "No Key")]
    r.shuffle(rows)
    return rows


def test_groups_equal_brute_force(spark, make_docs):
    rows = sample()
    docs = make_docs(rows).repartition(9)
    assert got(exact.groups(docs)) == by_hand(rows)
    assert got(exact.groups(docs, salts=1)) == by_hand(rows)


def test_equal_digests_do_not_make_texts_equal(spark, make_docs):
    rows = sample()
    weak = exact.groups(make_docs(rows), digest=lambda t: F.substring(F.sha2(t, 256), 1, 1))
    assert sorted(((r["id"], r["keep"], r["size"]) for r in weak.collect()), key=repr) == sorted((x[:3] for x in by_hand(rows)), key=repr)


def test_one_row_of_each_group_stays_with_all_its_columns(spark):
    rows = [(1, "a", "p"), (3, "A", "q"), (2, "a", "r"), (3, "a", "s"), (9, None, "t"), (4, "", "u"), (None, "z", "v"), (None, "Z", "w"), (5, "alone", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string").withColumns({"row": F.lit(1), "may_repeat": F.lit("m"), "bits": F.lit(2), "id": F.lit(3), "keep": F.lit(4), "size": F.lit(0), "a.b": F.lit(5)})
    kept = exact.deduplicated(docs)
    assert kept.columns == docs.columns
    out = sorted((((r["doc_id"], (r["text"] or "").lower()) for r in kept.collect())), key=repr)
    assert out == sorted([(3, "a"), (9, ""), (None, "z"), (5, "alone")], key=repr)
    assert got(exact.groups(docs)) == by_hand(rows)


def test_empty_table(spark, make_docs):
    assert exact.groups(make_docs([])).count() == 0
    assert exact.deduplicated(make_docs([])).count() == 0
