"""WARC archives: written by Spark's text writer, read back through verified chains of record boundaries.

Writing. Each page becomes one record string that ends in the two empty lines of the format, so the text writer's
line separator is the record separator and each task writes archives through the committed, shared file system. Of
pages with equal payloads (equal SHA-1 and length), that with the largest id is the response; the others become
revisits that refer to it. Only ids and digests of payloads that occur more than once take part in that join.

Reading. The text reader splits archives at the magic line, also within payloads, so each piece is only a candidate
record: offset, and successor = offset + header + Content-Length + 4. Offsets come from a running sum over a file's
narrow rows. Candidates whose successor is the next candidate form runs; a run has one pointer, from its last record
to a record in a later run. Pointer jumping from the file's start over runs, doubling each round, keeps what is
reachable; a magic line inside a payload starts nothing that the chain reaches. A record that holds such a line spans
several pieces, which are joined again for these records only.

Null payloads are empty; an empty payload is a payload like any other. Rows that share page id and payload are all
responses if theirs is the largest id. Page ids are escaped, so any text comes back, and null apart from empty; line breaks
in a url become blanks, and a null url reads as an empty one does, as null.
Further columns are not read. An empty table writes no records and reads as no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, scratch, small_side

MAGIC = "WARC/1.1\r\n"
GAP = "\r\n\r\n"
#: RFC 4648.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Records in one archive file.
RECORDS = 20_000


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 160 bits are eight groups of 20, each four letters."""
    hexa, out = F.sha1(payload), []
    for g in range(8):
        v = F.conv(F.substring(hexa, 5 * g + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def _clean(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "[\\r\\n]+", " ")


def write(pages: DataFrame, to: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> None:
    """Archives of all pages under the folder `to`; payloads below min_bytes are never revisits."""
    base = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("html"))
    base = base.withColumn("size", F.octet_length("html").cast("long")).withColumn("sha", F.sha1(F.col("html").cast("binary")))
    shared = base.where(F.col("size") >= min_bytes).groupBy("sha", "size").agg(F.max("id").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = small_side(cut(shared, "warc-shared"))
    rows = base.join(shared, ["sha", "size"], "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("keeper").eqNullSafe(F.col("id"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(GAP))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    urn = lambda c: F.when(c.isNull(), "<urn:page>").otherwise(F.concat(F.lit("<urn:page:"), F.url_encode(c.cast("string")), F.lit(">")))
    line = lambda name, c: F.concat(F.lit(f"{name}: "), c, F.lit("\r\n"))
    record = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", _clean(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("html").cast("binary")))),
        line("WARC-Payload-Length", F.col("size").cast("string")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", urn(F.col("keeper"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
        F.col("block"),
    )
    rows.withColumn("block", block).select(record.alias("value")).write.option("lineSep", GAP).option("maxRecordsPerFile", RECORDS).text(to)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What stands between magic lines, in order: file, block, place, value."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), "value")


def _placed(pieces: DataFrame, *columns: str) -> DataFrame:
    """Adds off, where the piece's magic line starts in its file; -1 - length or less for what stands before the first."""
    order = Window.partitionBy("file").orderBy("block", "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    size = F.col("len") + F.lit(len(MAGIC))
    return pieces.select("file", "block", "place", "len", *columns, (F.coalesce(F.sum(size).over(before), F.lit(0)) - len(MAGIC)).cast("long").alias("off"))


def _header(value: Column) -> dict[str, Column]:
    """Fields of a record that follows its magic line."""
    head = F.concat(F.lit("\r\n"), F.substring_index(value, GAP, 1), F.lit("\r\n"))
    urn = lambda c: F.when(c.startswith("<urn:page:"), F.try_url_decode(F.regexp_extract(c, "^<urn:page:(.*)>$", 1)))
    get = lambda name: F.regexp_extract(head, f"(?i)\\r\\n{name}:[ \\t]*([^\\r\\n]*)", 1)
    return {
        "type": F.lower(get("WARC-Type")),
        "id": urn(get("WARC-Record-ID")),
        "refers": urn(get("WARC-Refers-To")),
        "uri": get("WARC-Target-URI"),
        "digest": F.regexp_extract(get("WARC-Payload-Digest"), "^sha1:(.*)$", 1),
        "payload_len": get("WARC-Payload-Length").try_cast("long"),
        "length": get("Content-Length").try_cast("long"),
        "head": (F.octet_length(F.substring_index(value, GAP, 1)) + len(GAP)).cast("long"),
        "body": (F.octet_length(F.substring_index(value, GAP, 2)) + len(GAP)).cast("long"),
    }


def _payload() -> Column:
    """The payload's bytes, of columns value, head, body and length: the block without its HTTP header."""
    return F.expr("substring(cast(value as binary), cast(body + 1 as int), cast(greatest(0, head + length - body) as int))")


def chain(candidates: DataFrame) -> DataFrame:
    """Of candidates (file, off, succ), those that the chain from offset 0 of their file reaches, by pointer jumping over runs."""
    order = Window.partitionBy("file").orderBy("off")
    linked = candidates.select("file", "off", "succ").withColumn("starts", F.when(F.lag("succ").over(order) == F.col("off"), 0).otherwise(1))
    runs = cut(linked.withColumn("run", F.sum("starts").over(order)).drop("starts"), "warc-runs")
    last = runs.groupBy("file", "run").agg(F.max_by("succ", "off").alias("succ"))
    target = runs.select("file", F.col("off").alias("succ"), F.col("run").alias("to"))
    hop = cut(last.join(target, ["file", "succ"]).select("file", "run", "to", F.col("succ").alias("entry")), "warc-hop")
    reach = runs.where("off = 0").select("file", "run", F.col("off").alias("entry"))
    while not hop.isEmpty():
        there = hop.join(reach.select("file", "run"), ["file", "run"]).select("file", F.col("to").alias("run"), "entry")
        reach = cut(reach.unionByName(there), "warc-reach")
        again = hop.select("file", F.col("run").alias("to"), F.col("to").alias("to2"), F.col("entry").alias("entry2"))
        hop = cut(hop.drop("entry").join(again, ["file", "to"]).select("file", "run", F.col("to2").alias("to"), F.col("entry2").alias("entry")), "warc-hop")
    return runs.join(reach, ["file", "run"]).where("off >= entry").select("file", "off", "succ")


def read(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives under a path: file, off, type, id, refers, uri, digest (as written), payload_bytes, payload_digest (of the payload read; a revisit's as written)."""
    pieces = _pieces(spark, path)
    fields = _header(F.col("value"))
    parsed = pieces.select("file", "block", "place", "value", F.octet_length("value").cast("long").alias("len"), *(v.alias(k) for k, v in fields.items()))
    whole = F.col("len") >= F.col("head") + F.col("length")
    scanned = parsed.withColumn("whole", whole).withColumn("sha", F.when(whole & (F.col("type") != "revisit"), base32_sha1(_payload()))).drop("value")
    names = [c for c in scanned.columns if c not in ("file", "block", "place", "len")]
    placed = _placed(scanned, *names).where("off >= 0 and length is not null and length >= 0")
    placed = cut(placed.withColumn("succ", F.col("off") + len(MAGIC) + F.col("head") + F.col("length") + len(GAP)), "warc-candidates")
    kept = cut(placed.join(chain(placed).select("file", "off"), ["file", "off"]), "warc-kept")
    plain = kept.where("whole")
    if not kept.where("not whole").isEmpty():
        plain = plain.unionByName(_rejoined(spark, path, kept.where("not whole")).select(*plain.columns))
    empty = lambda c: F.when(F.col(c) != "", F.col(c))
    visit = F.col("type") == "revisit"
    return plain.select(
        "file", "off", "type", "id", "refers", empty("uri").alias("uri"), "digest",
        F.when(visit, F.col("payload_len")).otherwise(F.greatest(F.lit(0), F.col("head") + F.col("length") - F.col("body"))).alias("payload_bytes"),
        F.when(visit, F.col("digest")).otherwise(F.col("sha")).alias("payload_digest"),
    )


def _rejoined(spark: SparkSession, path: str, split: DataFrame) -> DataFrame:
    """Records that magic lines in their payload had split, from all their pieces."""
    pieces = _pieces(spark, path).withColumn("len", F.octet_length("value").cast("long"))
    files = small_side(cut(split.select("file").distinct(), "warc-files"))
    placed = _placed(pieces.join(files, "file", "left_semi"), "value")
    spans = split.select("file", F.col("off").alias("start"), "succ")
    marks = spans.select("file", F.col("start").alias("off"), "succ").withColumn("mark", F.lit(True))
    order = Window.partitionBy("file").orderBy("off")
    owned = placed.join(marks, ["file", "off"], "left").withColumn("start", F.last(F.when(F.col("mark"), F.col("off")), True).over(order)).withColumn("until", F.last("succ", True).over(order)).where("off >= start and off < until")
    parts = owned.groupBy("file", "start").agg(F.array_sort(F.collect_list(F.struct("off", "value"))).alias("parts"))
    text = parts.select("file", F.col("start").alias("off"), F.array_join(F.transform("parts", lambda p: p["value"]), MAGIC).alias("value"))
    fields = _header(F.col("value"))
    again = split.drop("sha", "body").join(text, ["file", "off"]).withColumn("body", fields["body"])
    return again.withColumn("sha", F.when(F.col("type") != "revisit", base32_sha1(_payload()))).drop("value")


def round_trip(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archive all pages in the shared folder and read them back: id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    to = scratch(spark, "warc")
    write(pages, to, min_bytes, id_col, url_col, html_col)
    kind = pages.schema[id_col].dataType
    return read(spark, to).select(F.col("id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers").cast(kind).alias("refers_to"))
