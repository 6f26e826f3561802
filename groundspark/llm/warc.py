"""WARC records and Merkle fixity audits.

Records of a file stand one after the other; every record has an ordered offset range. A leaf is
the digest of (offset, length, record digest); FANOUT neighbours make a parent, which hashes the
offset range and its children's digests in order, up to one root for each file. An audit compares
the roots of two replicas and descends, level by level, only below nodes that differ, so the work
below equal roots ends at the root. Ordered children make moved, missing and added records show.

Defined results: null payloads count as empty, null URLs as an empty URI; repeated record numbers
of a file are ordered by URL and payload digest; a file that one replica lacks mismatches as a whole;
empty tables give an empty result; extra columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

FANOUT = 16
BATCH = 64  # records that leave the parser together
PIECE = 1 << 20  # bytes that are unpacked at a time


def record_text(url: F.Column, payload: F.Column) -> F.Column:
    """A WARC/1.0 resource record as text: header lines, empty line, payload, two line ends."""
    payload = F.coalesce(payload, F.lit(""))
    return F.concat(F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"), payload, F.lit("\r\n\r\n"))


def records(df: DataFrame, file: F.Column, number: F.Column, url: F.Column, payload: F.Column) -> DataFrame:
    """file, number, url, offset, length, digest of the records that df's rows make; payloads don't leave the scan."""
    text = record_text(url, payload)
    rows = df.select(file.alias("file"), number.alias("number"), url.alias("url"), F.octet_length(text).cast("long").alias("length"), F.sha2(text, 256).alias("digest"))
    order = Window.partitionBy("file").orderBy("number", "url", "digest")
    rows = rows.withColumn("offset", F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))
    return rows.withColumn("leaf", (F.row_number().over(order) - 1).cast("long")).select("file", "leaf", "number", "url", "offset", "length", "digest")


def leaves(rows: DataFrame) -> DataFrame:
    """Level 0 of the trees."""
    sealed = F.sha2(F.concat_ws("|", F.col("offset").cast("string"), F.col("length").cast("string"), "digest"), 256)
    return rows.select("file", F.lit(0).alias("level"), F.col("leaf").alias("node"), "offset", (F.col("offset") + F.col("length")).alias("end"), sealed.alias("seal"))


def parents(level: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The next level: FANOUT neighbours each, so a group has that many rows at most."""
    kids = F.array_sort(F.collect_list(F.struct("node", "seal")))
    joined = F.array_join(F.transform(kids, lambda x: x["seal"]), "")
    up = level.groupBy("file", (F.col("level") + 1).alias("level"), F.floor(F.col("node") / fanout).alias("up")).agg(F.min("offset").alias("offset"), F.max("end").alias("end"), joined.alias("joined"))
    return up.select("file", "level", F.col("up").alias("node"), "offset", "end", F.sha2(F.concat_ws("|", F.col("offset").cast("string"), F.col("end").cast("string"), "joined"), 256).alias("seal"))


def trees(rows: DataFrame, largest: int, fanout: int = FANOUT) -> list[DataFrame]:
    """All levels of the trees of all files, leaves first; largest: most records of a file, which gives the height."""
    levels = [written(leaves(rows))]
    width = largest
    while width > 1:
        levels.append(written(parents(levels[-1], fanout)))
        width = -(-width // fanout)
    return levels


def audit(primary: DataFrame, replica: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """One row for each file: both roots, record and byte counts, nodes compared on the way down, and corrupt ranges.

    primary, replica: what records() gives. ranges: [offset, end) of leaves that differ or stand in one replica only, in order.
    """
    both = [written(primary), written(replica)]
    counts = both[0].unionByName(both[1]).groupBy("file").agg(F.max("leaf").alias("n")).agg(F.max("n")).first()[0]
    height = (counts if counts is not None else -1) + 1
    mine, theirs = (trees(x, height, fanout) for x in both)
    top = len(mine) - 1
    roots = written(_paired(mine[top], theirs[top]).select("file", "node", "offset", "end", F.col("a").alias("root_primary"), F.col("b").alias("root_replica")))
    compared = [roots.select("file", F.lit(1).alias("n"))]
    differing = roots.where("not root_primary <=> root_replica")
    for k in range(top - 1, -1, -1):
        up = differing.select("file", F.col("node").alias("up"))
        below = lambda level: level.withColumn("up", F.floor(F.col("node") / fanout)).join(up, ["file", "up"], "left_semi").drop("up")  # only children of nodes that differ are paired  # noqa: B023, E731
        pairs = written(_paired(below(mine[k]), below(theirs[k])))
        compared.append(pairs.groupBy("file").agg(F.count("*").alias("n")))
        differing = pairs.where("not a <=> b")
    ranges = differing.groupBy("file").agg(F.count("*").alias("n_corrupt"), F.array_sort(F.collect_list(F.struct("offset", "end"))).alias("ranges"))
    seen = compared[0]
    for x in compared[1:]:
        seen = seen.unionByName(x)
    seen = seen.groupBy("file").agg(F.sum("n").alias("n_compared"))
    sizes = both[0].groupBy("file").agg(F.count("*").alias("n_records"), F.sum("length").alias("n_bytes"))
    out = roots.drop("node", "offset", "end").join(sizes, "file", "left").join(seen, "file", "left").join(ranges, "file", "left")
    return out.select("file", F.coalesce("n_records", F.lit(0)).cast("long").alias("n_records"), F.coalesce("n_bytes", F.lit(0)).cast("long").alias("n_bytes"), "root_primary", "root_replica", F.col("root_primary").eqNullSafe(F.col("root_replica")).alias("intact"), F.col("n_compared").cast("long").alias("n_compared"), F.coalesce("n_corrupt", F.lit(0)).cast("long").alias("n_corrupt"), F.coalesce(F.transform("ranges", lambda x: F.concat_ws("-", x["offset"].cast("string"), x["end"].cast("string"))), F.array().cast("array<string>")).alias("ranges"))


def _paired(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Nodes of both sides: file, node, offset, end, a and b (their seals; null where a side lacks the node)."""
    other = theirs.select("file", "node", F.col("offset").alias("offset_b"), F.col("end").alias("end_b"), F.col("seal").alias("b"))
    both = mine.select("file", "node", "offset", "end", F.col("seal").alias("a")).join(other, ["file", "node"], "full")
    return both.select("file", "node", F.coalesce("offset", "offset_b").alias("offset"), F.coalesce("end", "end_b").alias("end"), "a", "b")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """file, offset, length, type, url, payload (binary) of the records of WARC files, plain or gzip by record.

    One task reads a file, so it must fit in its memory; records leave it BATCH at a time. A malformed tail gives a row of type 'broken' with what is left.
    """
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = parse_warc(data.as_py())
                while rows := list(islice(found, BATCH)):
                    cols = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["file", "offset", "length", "type", "url", "payload"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, offset long, length long, type string, url string, payload binary")


def inflated(data: bytes, at: int) -> tuple[bytes, int]:
    """The gzip member that starts at at, and where it ends."""
    one, out, end = zlib.decompressobj(31), [], at
    while end < len(data) and not one.eof:
        piece = data[end : end + PIECE]
        out.append(one.decompress(piece))
        end += len(piece) - len(one.unused_data)
    return b"".join(out), end


def parse_warc(data: bytes) -> Iterator[tuple[int, int, str, str | None, bytes]]:
    """offset, length, type, url, payload of each record; offsets count in the file as it is stored. Only the record at hand is copied."""
    at = 0
    while at < len(data):
        body, base, end = data, at, None
        if data.startswith(b"\x1f\x8b", at):
            try:
                body, end = inflated(data, at)
                base = 0
            except zlib.error:
                base = len(body)
        mark = body.find(b"\r\n\r\n", base)
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in body[base : max(mark, base)].split(b"\r\n")[1:])}
        n = fields.get(b"content-length", b"")
        first = mark + 4
        if not body.startswith(b"WARC/", base) or mark < 0 or not n.isdigit() or len(body) < first + int(n):
            yield at, len(data) - at, "broken", None, data[at:]
            return
        end = first + int(n) + 4 if end is None else end
        url = fields.get(b"warc-target-uri")
        yield at, end - at, fields.get(b"warc-type", b"").decode(), url.decode() if url is not None else None, body[first : first + int(n)]
        at = end


#: Of the query: records of a file, and the rule by which its replica's records are damaged.
FILE_RECORDS, DAMAGED, LOST = 128, 97, 389


def audited(pages: DataFrame) -> DataFrame:
    """Audit of the pages as WARC files of FILE_RECORDS page numbers, against a replica with known damage.

    In the replica every page whose number is divisible by DAMAGED has its last byte changed (empty pages get one), and
    every page with remainder 1 by LOST is missing. Pages without a number are dealt by their digest to files below zero and
    below those of all numbers.
    """
    loose, least = pages.agg(F.count_if(F.col("page_id").isNull()), F.min("page_id")).first()
    below = min(0, (least or 0) // FILE_RECORDS)
    seal = F.sha2(F.concat(F.coalesce("url", F.lit("")), F.lit("|"), F.coalesce("html", F.lit(""))), 256)
    spread = F.conv(F.left(seal, F.lit(8)), 16, 10).cast("long") % max(1, -(-loose // FILE_RECORDS))
    number = F.coalesce("page_id", below - 1 - spread)  # pages without a number make as many files as their count asks for
    file = F.coalesce(F.floor(F.col("page_id") / FILE_RECORDS), below - 1 - spread)
    kept = pages.select("page_id", "url", "html")
    hurt = F.when(F.col("page_id") % DAMAGED == 0, F.concat(F.expr("left(coalesce(html, ''), greatest(length(coalesce(html, '')) - 1, 0))"), F.lit("~"))).otherwise(F.col("html"))
    primary = records(kept, file, number, F.col("url"), F.col("html"))
    replica = records(kept.where(f"page_id is null or page_id % {LOST} <> 1").withColumn("html", hurt), file, number, F.col("url"), F.col("html"))
    return audit(primary, replica).withColumn("file", F.col("file").cast("long"))
