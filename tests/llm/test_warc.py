import base64
import hashlib

from pyspark.sql import functions as F

from freightlens.llm import warc
from freightlens.session import new_folder

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def sha(payload):
    return base64.b32encode(hashlib.sha1(payload.encode()).digest()).decode()


def by_hand(rows):
    payloads = [(p, h or "") for p, _, h in rows]
    first = {}
    for p, h in payloads:
        if p is not None:
            first[h] = min(p, first.get(h, p))
    return sorted(((p, len(h.encode()), sha(h), *(("response", None) if first.get(h, p) == p else ("revisit", first[h]))) for p, h in payloads), key=str)


ROWS = [
    (5, "http://a/", "<p>é</p>"), (3, "http://b/", "<p>é</p>"), (9, None, None), (1, "x", ""), (7, "http://c/\r\nX: y", FAKE),
    (8, "http://d/", "text " + FAKE * 3 + " more"), (10, "http://e/", "WARC/1.1\r\n"), (11, "u", "WARC/1.1\r\nWARC/1.1\r\n\r\n\r\n"), (12, "ü", "a\r\n\r\nb"),
    (13, "v", "WARC/1.1\r\nContent-Length: 99999999\r\n\r\n"), (14, "v", "WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n"), (None, "n", "only here"), (None, "n", "a\r\n\r\nb"), (3, "again", "<p>é</p>"),
]


def test_round_trip_with_magic_in_payloads(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(2)
    got = sorted((tuple(r) for r in warc.archived(pages).collect()), key=str)
    assert got == by_hand(ROWS)
    assert warc.archived(pages.limit(0)).count() == 0


def test_split_files_give_the_same_records(spark):
    """Splits of a few bytes fall into magics, headers and payloads."""
    path = new_folder(spark, "test-warc")
    rows = [(i, f"http://x/{i}", ("ab" * (i % 7) + FAKE) * (i % 3)) for i in range(60)]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
    whole = sorted((r["page"], r["type"], bytes(r["payload"]), r["whole"]) for r in warc.read_archives(spark, path).collect())
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert spark.read.option("lineSep", warc.MAGIC).text(path).rdd.getNumPartitions() > 10
        split = sorted((r["page"], r["type"], bytes(r["payload"]), r["whole"]) for r in warc.read_archives(spark, path).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert split == whole and len(whole) == 60 and all(r[3] for r in whole)
    assert {p: b for p, t, b, _ in whole if t == "response"} == {i: h.encode() for i, _, h in rows if i == min(j for j, _, g in rows if g == h)}


def test_payload_threshold(spark):
    pages = spark.createDataFrame([(1, "a", "xx"), (2, "b", "xx"), (3, "c", "yyyy"), (4, "d", "yyyy")], "page_id long, url string, html string")
    kinds = {r["page_id"]: r["record_type"] for r in warc.archived(pages, least=3).collect()}
    assert kinds == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_pointer_jumping_keeps_only_the_chain(spark):
    chain = [(0, 10), (10, 25), (25, 40), (40, 60)]
    strays = [(5, 10), (12, 40), (30, 33), (33, 999), (61, None)]
    nodes = spark.createDataFrame([("f", a, n) for a, n in chain + strays] + [("g", 0, 7), ("g", 3, 7)], "file string, at long, next long")
    got = {tuple(r) for r in warc.reachable(nodes).collect()}
    assert got == {("f", a) for a, _ in chain} | {("g", 0)}
