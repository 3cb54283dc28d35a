import hashlib
import random

from pyspark.sql import functions as F

from freightlens.llm import fingerprints


def jaccard(a, b):
    def shingles(t):
        words = (t or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()

    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def pairs(spark, rows):
    frame = spark.createDataFrame(rows, "a string, b string")
    return frame.select("a", "b", fingerprints.likeness(fingerprints.fingerprint(F.col("a")), fingerprints.fingerprint(F.col("b"))).alias("s")).collect()


def test_likeness_estimates_jaccard(spark):
    r = random.Random(1)
    rows = []
    for n in (6, 12, 40, 120, 500, 2000):
        for share in (0, 0.2, 0.5, 0.8, 1):
            for _ in range(8):
                words = [str(r.randrange(10**6)) for _ in range(n)]
                cut = int(n * share)
                rows.append((" ".join(words), " ".join(words[:cut] + [str(r.randrange(10**6)) for _ in range(n - cut)])))
    errors = [row["s"] - jaccard(row["a"], row["b"]) for row in pairs(spark, rows)]
    assert abs(sum(errors) / len(errors)) < 0.02
    assert (sum(e * e for e in errors) / len(errors)) ** 0.5 < 0.07
    assert max(map(abs, errors)) < 0.3


def test_odd_texts(spark):
    rows = [("", ""), (None, "  "), ("a", ""), ("A b", "a  B"), ("a b c", "d e f"), ("x " * 30_000, "x " * 9)]
    got = [r["s"] for r in pairs(spark, rows)]
    assert got[:4] == [1.0, 1.0, 0.0, 1.0] and got[4] < 0.2 and got[5] == 1.0


def test_every_empty_bin_is_filled_alike(spark):
    """One shingle fills all bins with its value; 200 shingles leave none at the mark of an empty bin."""
    frame = spark.createDataFrame([("one two three four five",), (" ".join(map(str, range(204))),)], "t string")
    one, many = [r["f"] for r in frame.select(fingerprints.fingerprint(F.col("t")).alias("f")).collect()]
    assert len(one) == len(many) == fingerprints.BINS and len(set(one)) == 1 and len(set(many)) > 50


def chain(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    return {r: order[(i + 1) % len(order)] for i, r in enumerate(order)}


def test_next_document(spark):
    r = random.Random(3)
    for ids in ([4], [1, 2], range(57), r.sample(range(10**12), 80), [-5, 0, 3, None], [None], [7, 7, 7, 1, 1, None, None]):
        rows = [(i, f"t{k}") for k, i in enumerate(ids)]
        frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_range", F.lit(9)).repartition(3)
        got = fingerprints.with_next(frame, "doc_id", ["text"], "text").collect()
        want = chain(rows)
        assert sorted((r["text"], r["next_text"]) for r in got) == sorted((a[1], b[1]) for a, b in want.items())
    assert fingerprints.with_next(spark.createDataFrame([], "doc_id long, text string"), "doc_id", ["text"], "text").count() == 0


def test_query(spark, sf):
    from freightlens.llm.queries import QUERIES

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    order = sorted(texts, reverse=True)
    rows = {r["doc_id"]: r for r in QUERIES["op10_document_fingerprints"](spark, sf).collect()}
    assert set(rows) == set(texts)
    errors, prints = [], {}
    for i, k in enumerate(order):
        text, other = texts[k], texts[order[(i + 1) % len(order)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        assert rows[k]["n_chars"] == len(text) and rows[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        errors += [rows[k]["near_edited"] - jaccard(text, edited), rows[k]["near_next"] - jaccard(text, other)]
        assert prints.setdefault(text, rows[k]["fingerprint"]) == rows[k]["fingerprint"]
    assert (sum(e * e for e in errors) / len(errors)) ** 0.5 < 0.06
