"""WARC archives with revisit records in place of repeated payloads.

Only headers (id, digest, length) are shuffled to find, for each payload digest, the record that keeps the
payload; a digest that all records share is one sum by task. Payloads stay where they are: the digests that repeat,
with their responses, are broadcast, if a count finds at most BROADCAST_ROWS of them. Beyond that headers alone are joined
with them, of which a digest of very many records is split like any skewed key of such a join, and the revisits among them are
brought to the pages by id and digest; so no payload that many records share is one key, and each payload moves once.
The archives are then written by Spark's text writer, whose line separator
is the two line ends that close a WARC record; so they go wherever Spark can write, and a lost task is written again.
Each record gets fresh headers. A task adds up the bytes of its records as they come, and goes on to the next file when
one more would make it longer than FILE_BYTES; so a long record is alone in its file, and has no part in the size of others.
The files are read back as binary files, inflated and parsed as streams by their Content-Length fields.

Defined cases: texts of any length are whole; extra columns are not read, whatever their names; a null payload is an empty one; payloads below `least_bytes` are never replaced; of equal
payloads the record with the largest id is the response, and so is each of repeated rows of that id; a null
id is smaller than any other; null urls give no target URI; an empty table gives no records.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import fresh_path, stash

END = "\r\n\r\n"
BROADCAST_ROWS = 500_000  # of 28 bytes each
FILE_BYTES, HEAD_BYTES, FILE_RECORDS = 256 << 20, 1024, 20_000  # of a file before compression; of the headers of a record, as reckoned
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean, payload binary"


def headers(pages: DataFrame) -> DataFrame:
    """page_id, digest and bytes of the payloads, in the shared folder."""
    html = F.coalesce("html", F.lit(""))
    return stash(pages.select("page_id", F.unhex(F.sha1(F.encode(html, "UTF-8"))).alias("digest"), F.octet_length(html).cast("long").alias("bytes")), "warc-headers")


def owners(heads: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """digest and owner, the largest id, of each payload that two records or more have."""
    found = heads.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("owner"), F.count("*").alias("n"))
    return stash(found.where("n > 1").select("digest", "owner"), "warc-owners")


def decide(pages: DataFrame, heads: DataFrame, repeated: DataFrame, few: int = BROADCAST_ROWS) -> DataFrame:
    """page_id, url, html, digest, bytes and, for a record whose payload another keeps, refers_to."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.unhex(F.sha1(F.encode(html, "UTF-8"))).alias("digest"), F.octet_length(html).cast("long").alias("bytes"))
    other = ~F.col("page_id").eqNullSafe(F.col("owner"))
    if repeated.limit(few + 1).count() <= few:
        told = rows.join(F.broadcast(repeated), "digest", "left").withColumn("refers_to", F.when(other, F.col("owner")))
    else:
        revisits = stash(heads.join(repeated, "digest").where(other & F.col("owner").isNotNull()).select("page_id", "digest", F.col("owner").alias("refers_to")).distinct(), "warc-revisits")
        a, b = rows.alias("a"), revisits.alias("b")
        told = a.join(b, F.col("a.page_id").eqNullSafe(F.col("b.page_id")) & (F.col("a.digest") == F.col("b.digest")), "left").select("a.*", "b.refers_to")
    return told.select("page_id", "url", F.lower(F.hex("digest")).alias("digest"), "bytes", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "refers_to")


def file_number(size: Column, most: int) -> Column:
    """A number that grows, row by row of a task, when one more record would make the sum of sizes since it last grew greater than `most`."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        number, held = 0, 0
        for batch in batches:
            out = []
            for n in batch:
                if held and held + n > most:
                    number, held = number + 1, 0
                held += n
                out.append(number)
            yield pd.Series(out, dtype="int64")

    return F.pandas_udf(run, "long")(size)


def _lines(*fields: tuple[str, Column]) -> Column:
    return F.concat(*(F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit("")) for name, value in fields))


def record(date: str) -> Column:
    """The whole record as text, without the two line ends that close it."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\n"), _lines(("Content-Type", F.lit("text/html; charset=utf-8")), ("Content-Length", F.col("bytes"))), F.lit("\r\n"))
    revisit = F.col("refers_to").isNotNull()
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    own = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    target = F.regexp_replace(F.regexp_replace("url", r"[\r\n]", ""), r"^$", "about:blank")
    head = _lines(
        ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        ("WARC-Record-ID", F.coalesce(own(F.col("page_id")), F.lit("<urn:page:none>"))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        ("WARC-Profile", F.when(revisit, PROFILE)),
        ("WARC-Refers-To", F.when(revisit, own(F.col("refers_to")))),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", F.octet_length(block)),
    )
    return F.concat(F.lit("WARC/1.1\r\n"), head, F.lit("\r\n"), block)


def write(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", least_bytes: int = 1000, file_bytes: int = FILE_BYTES) -> None:
    """Gzipped archives under path; date: of the crawl, as the table has none."""
    heads = headers(pages)
    rows = decide(pages, heads, owners(heads, least_bytes))
    size = HEAD_BYTES + F.when(F.col("refers_to").isNull(), F.col("bytes")).otherwise(0)
    rows = rows.withColumn("file", file_number(size, file_bytes)).select(record(date).alias("value"), "file")
    rows.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).partitionBy("file").text(path)


FIELD = re.compile(rb"(?m)^([A-Za-z-]+): (.*?)\r$")


class Stream:
    """The bytes of a gzipped file, of which only what is being read is held inflated."""

    def __init__(self, raw: bytes, step: int = 1 << 20):
        self.raw, self.step, self.at, self.held = raw, step, 0, bytearray()
        self.inflate = zlib.decompressobj(47)

    def more(self) -> bool:
        """Whether there was more to inflate."""
        while True:
            part = self.inflate.unconsumed_tail
            if not part:
                part, self.at = self.raw[self.at : self.at + self.step], self.at + self.step
            out = self.inflate.decompress(part, self.step)
            self.held += out
            if out or not part:
                return bool(out)

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self.more():
            pass
        if len(self.held) < n:
            raise ValueError("an archive ends within a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def head(self) -> bytes:
        """All up to an empty line, with it; nothing at the end of the file."""
        seen = 0
        while (end := self.held.find(b"\r\n\r\n", seen)) < 0:
            seen = max(0, len(self.held) - 3)
            if not self.more():
                if self.held:
                    raise ValueError("an archive ends within a header")
                return b""
        return self.take(end + 4)


def parse(raw: bytes) -> Iterator[tuple]:
    """Records of a gzipped archive, as the columns of READ."""
    stream, number = Stream(raw), lambda x: int(x[10:-1]) if x and x != "<urn:page:none>" else None
    fields = lambda block: {k.lower(): v.decode() for k, v in FIELD.findall(block)}
    while lines := stream.head():
        head = fields(lines)
        block = stream.take(int(head[b"content-length"]))
        start = block.index(b"\r\n\r\n") + 4
        http, payload = fields(block[:start]), block[start:]
        digest, kind = head[b"warc-payload-digest"].removeprefix("sha1:"), head[b"warc-type"]
        intact = hashlib.sha1(payload).hexdigest() == digest if kind == "response" else None
        yield number(head[b"warc-record-id"]), head.get(b"warc-target-uri"), int(http[b"content-length"]), digest, kind, number(head.get(b"warc-refers-to")), intact, payload
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its Content-Length says")


def read(spark, path: str, payload: bool = True) -> DataFrame:
    """Records of all archives under path. Of a file a task holds the gzipped bytes and what it has inflated for one record."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for raw in batch["content"]:
                rows = parse(raw)
                while some := list(_batch(rows, payload)):
                    frame = pd.DataFrame(some, columns=[x.split()[0] for x in READ.split(", ")])
                    yield frame.astype({"page_id": "Int64", "refers_to": "Int64", "intact": "boolean"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(path).select("content")
    return files.mapInPandas(run, READ)


def _batch(rows: Iterator[tuple], payload: bool, records: int = 2000, size: int = 8 << 20) -> Iterator[tuple]:
    """The next rows, of bounded number and bytes."""
    held = 0
    for k, r in enumerate(rows, 1):
        held += len(r[-1]) if payload else 0
        yield r if payload else (*r[:-1], None)
        if k == records or held > size:
            return


def round_trip(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """The records of pages, written to fresh archives in the shared folder and read back from them."""
    path = fresh_path(pages.sparkSession, "warc")
    write(pages, path, least_bytes=least_bytes)
    return read(pages.sparkSession, path, payload=False).drop("payload")
