"""Web archives: writing records with revisits, and reading them back by boundary-chain verification.

A reader can't tell a record's first line from the same bytes inside a payload. So tasks emit every place that looks like a
record, with the place where its successor must begin. Whatever can be reached from the start of its file by these links is a
record; pointer jumping finds that in as many rounds as the number of records has bits.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from graphreports.llm.common import stored
from graphreports.runtime import cut_lineage

MAGIC = b"WARC/1.1\r\n"
LEAST = 100  # bytes of a payload worth a revisit
PER_FILE = 2000  # records of a file: what one task reads at once
DATE = "2024-01-01T00:00:00Z"


def records(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type, refers_to of each page."""
    payload = F.coalesce("html", F.lit(""))
    sized = pages.select("page_id", "url", payload.alias("html"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"))
    narrow = pages.select("page_id", F.octet_length(payload).alias("n"), F.sha2(payload, 256).alias("first_digest"))
    first = narrow.filter(F.col("n") >= least).groupBy("first_digest").agg(F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("times")).filter("times > 1")
    # Payloads too small to refer to each have a key of their own, so that they don't meet in one task.
    key = F.when(F.col("payload_bytes") >= least, F.col("payload_digest")).otherwise(F.concat(F.lit("p"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    joined = sized.withColumn("first_digest", key).join(first, "first_digest", "left")
    again = F.col("first_page").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_page"))
    return joined.select(
        "page_id", "url", "html", "payload_bytes", "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first_page")).alias("refers_to"),
    )


def _record(uri_prefix: str = "urn:page:") -> Column:
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), r"[\x00-\x1f\x7f]", " "), F.lit("\r\n"))).otherwise("")
    revisit = F.col("record_type") == "revisit"
    body = F.when(revisit, "").otherwise(F.col("html"))
    return F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", F.col("record_type")), line("WARC-Date", F.lit(DATE)),
        line("WARC-Record-ID", F.concat(F.lit(f"<{uri_prefix}"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        line("WARC-Page", F.col("page_id")), line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))), line("WARC-Payload-Length", F.col("payload_bytes")),
        line("WARC-Refers-To", F.concat(F.lit(f"<{uri_prefix}"), F.col("refers_to").cast("string"), F.lit(">"))),
        line("WARC-Refers-To-Page", F.col("refers_to")),
        F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body,
    )


def write(pages: DataFrame, path: str, least: int = LEAST, per_file: int = PER_FILE) -> None:
    """Write one record per page into gzip files of at most ``per_file`` records each.

    Of equal payloads of at least ``least`` bytes the one with the smallest page_id is a response, the others revisit it; rows that
    repeat that page_id are responses too, as are pages with a null page_id if no other has their payload. A null html is an
    empty payload; control characters in a url become spaces; other columns are not read; an empty table gives no records.
    """
    out = records(pages, least).select(_record().alias("value"))
    out.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def _plain(content: bytes) -> bytes:
    """A file without its compression; it may have several gzip members."""
    out = []
    while content[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(content))
        content = member.unused_data
    return b"".join([*out, content]) if out else content


_FIELDS = {b"warc-type": "record_type", b"warc-page": "page_id", b"warc-target-uri": "url", b"warc-payload-digest": "digest", b"warc-payload-length": "payload_bytes", b"warc-refers-to-page": "refers_to"}
_NUMBERS = ("page_id", "payload_bytes", "refers_to")


def parse(data: bytes) -> list[dict]:
    """Every place in a file that looks like a record: start, next, and what its header says.

    A place is left out if its header is not whole, or if neither a record nor the end of the file follows it.
    """
    out, at = [], data.find(MAGIC)
    while at >= 0:
        head = data.find(b"\r\n\r\n", at)
        found = {}
        for line in data[at + len(MAGIC) : head].split(b"\r\n") if head > 0 else ():
            name, _, value = line.partition(b":")
            found[name.strip().lower()] = value.strip()
        if (size := found.get(b"content-length", b"")).isdigit():
            body = head + 4
            stop = body + int(size)
            if data[stop : stop + 4] == b"\r\n\r\n" and (stop + 4 == len(data) or data.startswith(MAGIC, stop + 4)):
                row = {to: found[name].decode("utf-8", "replace") for name, to in _FIELDS.items() if name in found}
                row |= {n: int(row[n]) for n in _NUMBERS if n in row}
                digest = hashlib.sha256(data[body:stop]).hexdigest() if row.get("record_type") == "response" else row.get("digest", "").removeprefix("sha256:")
                out.append(row | {"start": at, "next": stop + 4 if stop + 4 < len(data) else None, "payload_digest": digest, "block_bytes": stop - body})
        at = data.find(MAGIC, at + 1)
    return out


COLUMNS = "file string, start long, next long, page_id long, url string, payload_bytes long, block_bytes long, payload_digest string, record_type string, refers_to long"


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every place in the files of a folder that looks like a record."""
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, content in zip(b["path"], b["content"], strict=True):
                rows = pd.DataFrame([{"file": file, **r} for r in parse(_plain(content))], columns=names)
                for n in ("start", "next", "page_id", "payload_bytes", "block_bytes", "refers_to"):
                    rows[n] = rows[n].astype("Int64")
                yield rows

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(scan, COLUMNS)


def reachable(links: DataFrame) -> DataFrame:
    """(file, start, next) to the (file, start) that the chain from offset 0 passes; next is null at the end of a file.

    Each round a record that is reached also reaches where its pointer leads, and all pointers double their stride.
    """
    state = cut_lineage(links.select("file", "start", F.col("next").alias("jump"), (F.col("start") == 0).alias("reached")))
    while not state.filter("jump is not null").isEmpty():
        hit = state.filter("reached and jump is not null").select("file", F.col("jump").alias("start"), F.lit(True).alias("hit")).distinct()
        on = state.select("file", F.col("start").alias("jump"), F.col("jump").alias("further"))
        # Ends of chains have no pointer to join on; left alone they would all meet under one null key.
        going = state.filter("jump is not null").join(on, ["file", "jump"], "left").select("file", "start", F.col("further").alias("jump"), "reached")
        moved = going.union(state.filter("jump is null").select("file", "start", "jump", "reached"))
        moved = moved.join(hit, ["file", "start"], "left").select("file", "start", "jump", (F.col("reached") | F.coalesce("hit", F.lit(False))).alias("reached"))
        state = cut_lineage(moved)
    return state.filter("reached").select("file", "start")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives in a folder: file, start, page_id, url, payload_bytes, payload_digest, record_type, refers_to."""
    found = stored(candidates(spark, path), "warc-candidates")
    return found.join(reachable(found), ["file", "start"]).drop("next")


def roundtrip(pages: DataFrame, path: str) -> DataFrame:
    """Write archives of all pages into a new folder and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    write(pages, path)
    size = F.when(F.col("record_type") == "response", F.col("block_bytes")).otherwise(F.col("payload_bytes"))
    return read(pages.sparkSession, path).select("page_id", size.alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "url", "file", F.col("start").alias("record_start"))
