"""Content-addressed web archive: payload bytes once, exact record headers apart, records rebuilt by a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, staged

#: RFC 4648 alphabet, a fixed value
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: 40 hex digits are eight groups of 20 bits, each four letters."""
    digest = F.sha1(payload)
    letters = []
    for i in range(8):
        group = F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(group, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*letters)


def _header(lines: list[tuple[str, Column]]) -> Column:
    """One header line for each name with a value; a null value leaves its line out.  Line ends inside a value become blanks."""
    clean = lambda v: F.regexp_replace(v.cast("string"), "[\r\n]+", " ")
    return F.concat_ws(CRLF, F.lit("WARC/1.1"), *[F.concat(F.lit(f"{k}: "), clean(v)) for k, v in lines], F.lit(CRLF))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", hot_groups: int = 1000) -> None:
    """Writes one record per row under ``path``: tables ``payloads`` (digest, payload) and ``headers`` (record key, exact
    header bytes, digest).

    A payload is the text in UTF-8, null counting as empty.  Rows with equal payloads of at least ``min_revisit_bytes``
    bytes share one stored payload: the row with the smallest id is a ``response``, the rest are ``revisit`` records that
    name it.  Smaller payloads are stored once too, but every record is a response.  Of rows that repeat the smallest
    id with the same payload one is the response.  Null ids count as larger than any other; a revisit
    of a response without id has no refers-to line.  A null url leaves its line out.  An empty table writes an empty archive.

    Payloads are grouped by digest *and* bytes, so equality never rests on the digest; two payloads with one
    SHA-256 stop the job.  Digests beyond one in ``hot_groups`` of the rows are joined by broadcast (never more than
    ``hot_groups`` of them), all others by a shuffle on the digest.
    """
    src = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload")
    ).withColumn("digest", F.unhex(F.sha2("payload", 256)))
    records = staged(
        src.select("id", "url", "digest", F.octet_length("payload").cast("bigint").alias("n_bytes"), base32_sha1(F.col("payload")).alias("sha1"), F.monotonically_increasing_id().alias("row_no")), "warc-records"
    )
    stored = src.groupBy("digest", "payload").agg(F.count(F.lit(1)).alias("n"))
    stored.write.parquet(f"{path}/payloads")
    # nulls last: smallest (id is null, id, row_no)
    groups = records.groupBy("digest").agg(
        F.min(F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("row_no"))).alias("first"), F.count(F.lit(1)).alias("n")
    ).select("digest", "n", F.col("first.id").alias("first_id"), F.col("first.row_no").alias("first_no"))
    groups = staged(groups, "warc-groups")
    least = groups.agg((F.sum("n") / hot_groups).alias("least"))
    hot = staged(groups.filter("n > 1").join(F.broadcast(least), F.col("n") > F.col("least")).drop("least"), "warc-hot")
    cold = groups.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
    joined = records.join(F.broadcast(hot), "digest").unionByName(records.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(cold, "digest"))
    revisit = (F.col("n_bytes") >= min_revisit_bytes) & (F.col("row_no") != F.col("first_no"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    header = _header([
        ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        ("WARC-Record-ID", urn(F.col("id"))),
        ("WARC-Target-URI", F.col("url")),
        ("WARC-Date", F.lit(date)),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        ("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ("WARC-Refers-To", F.when(revisit, urn(F.col("first_id")))),
        ("Content-Type", F.lit("text/html; charset=utf-8")),
        ("Content-Length", F.when(revisit, 0).otherwise(F.col("n_bytes"))),
    ])
    joined.select("id", "row_no", header.cast("binary").alias("header"), "digest").write.parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records rebuilt from the archive at ``path``: ``id, header, payload, record, type, payload_digest, refers_to``.

    ``record`` is the record as WARC bytes (a revisit has an empty block), ``payload`` the full content, of revisits too.
    The content is hashed again; one that does not match its address, or is stored twice, stops the job.
    """
    headers = spark.read.schema("id bigint, row_no bigint, header binary, digest binary").parquet(f"{path}/headers")
    payloads = spark.read.schema("digest binary, payload binary, n bigint").parquet(f"{path}/payloads")
    return _rebuilt(headers, payloads)


def _field(header: Column, name: str) -> Column:
    found = F.regexp_extract(header, f"\r\n{name}: ([^\r]*)\r\n", 1)
    return F.when(found != "", found)


def _rebuilt(headers: DataFrame, payloads: DataFrame, hot_groups: int = 1000, salts: int = 64) -> DataFrame:
    # an address used by more than a thousandth of the records is dealt to ``salts`` copies of its one payload
    least = payloads.agg((F.sum("n") / hot_groups).alias("least"))
    hot = F.broadcast(staged(payloads.filter("n > 1").select("digest", "n").join(F.broadcast(least), F.col("n") > F.col("least")).select("digest", F.lit(True).alias("hot")), "warc-hot"))
    if payloads.groupBy("digest").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").limit(1).count():
        raise ValueError("the archive stores an address twice")
    right = F.unhex(F.sha2("payload", 256)) == F.col("digest")
    store = (
        payloads.join(hot, "digest", "left")
        .select("digest", F.when(right, F.col("payload")).otherwise(F.raise_error(F.lit("payload does not match its digest")).cast("binary")).alias("payload"), F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    )
    dealt = headers.join(hot, "digest", "left").withColumn("salt", F.when(F.col("hot"), F.pmod("row_no", F.lit(salts)).cast("int")).otherwise(F.lit(0)))
    joined = dealt.join(store, ["digest", "salt"], "left")
    payload = F.coalesce(F.col("payload"), F.raise_error(F.lit("payload missing")).cast("binary"))
    text = F.col("header").cast("string")
    kind = _field(text, "WARC-Type")
    block = F.when(kind == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    refers = F.regexp_extract(text, "\r\nWARC-Refers-To: <urn:page:(-?[0-9]+)>\r\n", 1)
    return joined.withColumn("payload", payload).select(
        "id", "header", "payload", F.concat("header", block, F.lit(b"\r\n\r\n")).alias("record"), kind.alias("type"),
        F.regexp_replace(_field(text, "WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"),
        F.when(refers != "", refers).cast("bigint").alias("refers_to"),
    )
