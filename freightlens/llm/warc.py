"""WARC archives: writing records with payload de-duplication, and reading them back by boundary-chain verification.

Writing: one record per page, through Spark's own text writer, so that retried tasks and remote stores are handled.
Reading: files are split anywhere and every occurrence of the magic is a candidate record, also inside payloads. Each
candidate names its successor: where it says that it ends. Starting from the first byte of each file, pointer jumping
marks what can be reached, twice as far each round, and only that is kept. A payload that holds the magic was torn
apart by the splitting and is put together again from the candidates between its record and the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from freightlens.llm.exact import HOT_PARTS, filter_of, marked
from freightlens.llm.tables import join_split
from freightlens.session import new_folder, stage

#: Fixed strings of the format.
MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base32: four groups of ten hexadecimal digits are eight digits of base 32 each."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _line(name: str, value: Column) -> Column:
    """A header line; nothing if the value is NULL. Line breaks in values are percent-encoded."""
    clean = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n")), F.lit(""))


def _urn(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page.cast("string"), F.lit(">"))


def write_archives(pages: DataFrame, path: str, page: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> None:
    """Write one record per row of `pages` into uncompressed archives under `path`.

    Of rows with equal payloads (html in UTF-8, NULL as empty) of `least` bytes or more, those with the smallest page are
    responses and the rest revisits that refer to it; shorter payloads are always responses. Rows that repeat the smallest
    page are responses too; rows without a page are revisits where their payload has a page, else responses. Payloads that
    occur once miss a filter of fixed size over the repeated digests and are written where they are read.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("string")
    rows = pages.select(F.col(page).alias("page"), F.col(url).alias("url"), payload.alias("payload"), base32_sha1(payload).alias("digest"))
    counted = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n"))
    counted = stage(counted.where("n > 1"), "repeated")
    flagged = marked(rows, filter_of(counted))
    hot = counted.where(F.col("n") * HOT_PARTS >= pages.count())
    alone = flagged.where("NOT may_repeat").withColumn("first", F.lit(None).cast(pages.schema[page].dataType))
    rows = alone.unionByName(join_split(flagged.where("may_repeat"), counted.select("digest", "first"), "digest", hot))
    revisit = F.coalesce(F.octet_length("payload") >= least, F.lit(False)) & F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first"))
    block = F.when(revisit, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), F.col("payload")))
    head = F.concat(
        F.lit(MAGIC), _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), _line("WARC-Record-ID", _urn(F.col("page"))),
        _line("WARC-Date", F.lit(DATE)), _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("WARC-Refers-To", F.when(revisit, _urn(F.col("first")))), _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _line("Content-Type", F.lit("application/http;msgtype=response")), _line("Content-Length", F.octet_length(block)), F.lit("\r\n"))
    rows.select(F.concat(head, block).alias("value")).write.option("lineSep", END).text(path)


# ---- reading ----

def _lines(spark: SparkSession, path: str) -> DataFrame:
    """What follows each occurrence of the magic: file, split, line (in the order of the split), size (to the next magic), body."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("line"), (F.octet_length("value").cast("long") + len(MAGIC)).alias("size"), F.col("value").alias("body"))


def _located(lines: DataFrame) -> DataFrame:
    """`lines` with the place of each magic in its file: the sum of what stands before it, whole splits first, then lines of
    its split, so no window spans a file's lines. What stands before the first magic of a file is an empty line, dropped."""
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("file", "split").agg(F.sum("size").alias("bytes"))
    start = F.coalesce(F.sum("bytes").over(before(Window.partitionBy("file").orderBy("split"))), F.lit(0))
    inner = F.coalesce(F.sum("size").over(before(Window.partitionBy("file", "split").orderBy("line"))), F.lit(0))
    placed = lines.withColumn("_inner", inner).join(splits.select("file", "split", start.alias("_start")), ["file", "split"])
    return placed.withColumn("at", F.col("_start") + F.col("_inner") - len(MAGIC)).where("at >= 0").drop("_start", "_inner")


def _described(rows: DataFrame) -> DataFrame:
    """Rows with a body, the text of a record behind its magic: the headers, `ends` (bytes from the magic to the record's end by
    its own word, NULL if it says none), and the payload, all of which is there if the body has that length."""
    def header(name: str) -> Column:
        found = F.regexp_extract("_head", rf"(?:^|\r\n){name}: ([^\r\n]*)", 1)
        return F.when(found != "", found)

    number = lambda name: F.expr(rf"try_cast(regexp_extract(_head, '(?:^|\\r\\n){name}: <urn:page:(-?[0-9]+)>', 1) AS long)")
    rows = rows.withColumn("_head", F.substring_index("body", END, 1))
    begin = len(MAGIC) + F.octet_length("_head") + len(END)
    length = F.expr(r"try_cast(regexp_extract(_head, '(?:^|\\r\\n)Content-Length: ([0-9]+)', 1) AS long)")
    rows = rows.withColumns({"_begin": begin, "ends": begin.cast("long") + length + len(END)})
    block = F.substring(F.col("body").cast("binary"), F.col("_begin") - len(MAGIC) + 1, (F.col("ends") - F.col("_begin") - len(END)).cast("int"))
    block = F.coalesce(block, F.lit(b""))
    rows = rows.withColumns({"type": header("WARC-Type"), "page": number("WARC-Record-ID"), "refers_to": number("WARC-Refers-To"),
                             "url": header("WARC-Target-URI"), "digest": F.regexp_extract(header("WARC-Payload-Digest"), "^sha1:([A-Z2-7]+)$", 1),
                             "_block": block})
    # the HTTP head follows the record's head; neither has the end mark inside
    skip = F.octet_length(F.substring_index(F.substring_index(F.col("body"), END, 2), END, -1)) + len(END)
    payload = F.when(F.col("type") == "response", F.substring(F.col("_block"), skip + 1, F.octet_length("_block"))).otherwise(F.lit(b""))
    return rows.withColumn("payload", payload).drop("_head", "_begin", "_block")


def reachable(nodes: DataFrame) -> DataFrame:
    """(file, at) of the nodes (file, at, next) on the chain that begins at 0 in each file, by pointer jumping.

    Each round doubles both the marked stretch of the chain and the length of all jumps, so rounds grow with the logarithm
    of the records of a file. Pointers that lead to no node end their chain.
    """
    jumps = stage(nodes.select("file", "at", "next", (F.col("at") == 0).alias("hit")), "warc-chain")
    while True:
        landed = jumps.where("hit AND next IS NOT NULL").select("file", F.col("next").alias("at"), F.lit(True).alias("landed")).distinct()
        ahead = jumps.select("file", F.col("at").alias("next"), F.col("next").alias("after"))
        moved = jumps.join(ahead, ["file", "next"], "left").join(landed, ["file", "at"], "left").select(
            "file", "at", F.col("after").alias("next"), (F.col("hit") | F.coalesce("landed", F.lit(False))).alias("hit"))
        jumps = stage(moved, "warc-chain")
        if not jumps.where("hit AND next IS NOT NULL").take(1):
            return jumps.where("hit").select("file", "at")


def _owners(nodes: DataFrame) -> DataFrame:
    """(file, part, at): for each node (file, split, at, kept) not kept, the last one kept before it. Within a split by a
    running value, across splits by a window over splits alone."""
    kept = F.when(F.col("kept"), F.col("at"))
    here = Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = nodes.groupBy("file", "split").agg(F.max(kept).alias("last")).withColumn("carried", F.max("last").over(before)).drop("last")
    return nodes.withColumn("own", F.max(kept).over(here)).where("NOT kept").join(splits, ["file", "split"]).select(
        "file", F.col("at").alias("part"), F.coalesce("own", "carried").alias("at"))


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The true records of all archives under `path`: file, at, type, page, url, digest (as stated), refers_to, payload_bytes,
    payload_digest, whole (the record has its stated length and a response its stated digest), and on wish the payload
    (binary; empty for revisits).

    Bodies are read twice instead of being moved about: once to describe every candidate, and again for those that must be
    put together, or for all if payloads are wanted.
    """
    facts = ["type", "page", "url", "digest", "refers_to", "payload_bytes", "payload_digest", "ends"]

    def digested(rows: DataFrame) -> DataFrame:
        return rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": base32_sha1(F.col("payload"))})

    first = digested(_described(_lines(spark, path))).select("file", "split", "line", "size", *facts)
    found = stage(_located(stage(first, "warc-lines")), "warc-found")
    kept = stage(reachable(found.select("file", "at", (F.col("at") + F.col("ends")).alias("next"))), "warc-kept")
    known = found.join(kept.withColumn("hit", F.lit(True)), ["file", "at"], "left").withColumn("kept", F.col("hit").isNotNull())
    known = stage(known.drop("hit"), "warc-known")
    plain = known.where("kept AND ends <=> size")
    # a candidate that was not reached stands in the payload of the last record reached before it
    owners = _owners(known.select("file", "split", "at", "kept")).select("file", "part", "at")
    heads = known.where("kept" if payloads else "kept AND NOT ends <=> size").select("file", F.col("at").alias("part"), "at")
    wanted = heads.unionByName(owners)
    names = ["file", "at", *facts, "size"] + ["payload"] * payloads
    records = plain.select(*names) if not payloads else None
    if payloads or wanted.take(1):
        again = _located(_lines(spark, path).select("file", "split", "line", "size")).withColumnRenamed("at", "part")
        where = again.join(wanted, ["file", "part"]).select("file", "split", "line", "part", "at")
        bodies = _lines(spark, path).select("file", "split", "line", "body").join(where, ["file", "split", "line"])
        joined = bodies.groupBy("file", "at").agg(F.sort_array(F.collect_list(F.struct("part", "body"))).alias("parts"))
        joined = joined.select("file", "at", F.array_join(F.col("parts.body"), MAGIC).alias("body"))
        joined = joined.withColumn("size", F.octet_length("body").cast("long") + len(MAGIC))
        repaired = digested(_described(joined)).select(*names)
        records = repaired if records is None else records.unionByName(repaired)
    intact = F.coalesce(F.col("ends") == F.col("size"), F.lit(False)) & ((F.col("type") != "response") | (F.col("payload_digest") == F.col("digest")))
    return records.withColumn("whole", intact).drop("ends", "size")


def archived(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """Write `pages` to archives in the shared folder and read them back: one row per page with page, payload_bytes,
    payload_digest, record_type, refers_to. Digests are computed from what was read; revisits take size and digest
    from the response that they refer to."""
    spark = pages.sparkSession
    path = new_folder(spark, "warc")
    write_archives(pages, path, page, url, html, least)
    records = read_archives(spark, path, payloads=False).select(
        "page", "type", "refers_to", F.col("payload_bytes").alias("bytes"), F.col("payload_digest").alias("sha"))
    records = stage(records, "warc-read")
    targets = records.where("type = 'response' AND page IS NOT NULL").groupBy(F.col("page").alias("to")).agg(
        F.first("bytes").alias("to_bytes"), F.first("sha").alias("to_sha"))
    repeats = records.where("type = 'revisit'").withColumnRenamed("refers_to", "to")
    hot = repeats.groupBy("to").agg(F.count("*").alias("n")).where(F.col("n") * HOT_PARTS >= records.count())
    told = join_split(repeats, targets, "to", hot).select(F.col("page").alias(page), F.col("to_bytes").alias("payload_bytes"),
                                                          F.col("to_sha").alias("payload_digest"), F.col("type").alias("record_type"), F.col("to").alias("refers_to"))
    others = records.where("type IS DISTINCT FROM 'revisit'").select(
        F.col("page").alias(page), F.col("bytes").alias("payload_bytes"), F.col("sha").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")
    return others.unionByName(told)
