"""WARC archives as a table of chunks.

An oversized payload is cut into segments: the first stands in the ``response`` record,
the others in ``continuation`` records that name it and their number (WARC/1.0, record
segmentation). A chunk is therefore a record of its own, in the archive and in the table,
and neither writing nor reading nor digesting holds a whole payload: the reader follows
the lines of a file by ``Content-Length``, and the digest of a record in several chunks is
carried on from chunk to chunk, sorted by record and number.

Archives are written and read by Spark's text source (gzip, so that a file is read from
its start), hence on any file system that Spark reaches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: names and line ends of the format
BREAK = "\r\n"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n\r\n"

CHUNKS = (
    "record_id string, page_id long, url string, record_type string, refers_to long,"
    " payload_bytes long, payload_digest string, chunk_no int, last boolean, chunk binary"
)


def _digested(pages: DataFrame, page_id: str, url: str, payload: str) -> DataFrame:
    data = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.col(url).cast("string").alias("url"),
        data.alias("data"),
    )
    return rows.select(
        "*", F.sha1("data").alias("digest"), F.octet_length("data").cast("long").alias("bytes")
    )


def write_archives(
    pages: DataFrame,
    path: str,
    page_id: str = "page_id",
    url: str = "url",
    payload: str = "html",
    chunk: int = 1 << 16,
    least: int = 1000,
) -> None:
    """Write a record per row to gzipped archives under ``path``.

    Among rows with equal payloads of at least ``least`` bytes the largest id is the
    response, the others are revisits that refer to it; smaller payloads are always
    responses. A null payload is empty. Rows with a null id are responses. Rows that
    repeat the largest id and its payload are all responses. Other columns are not
    written. An empty table gives an archive without records.
    """
    rows = _digested(pages, page_id, url, payload)
    large = rows.filter(F.col("bytes") >= least).select("page_id", "digest")
    originals = large.groupBy("digest").agg(
        F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n")
    )
    revisits = (
        large.join(originals.filter("n > 1"), "digest")
        .filter(F.col("page_id") < F.col("original"))
        .select("page_id", "digest", "original")
        .distinct()
    )
    known = rows.join(revisits, ["page_id", "digest"], "left").withColumn(
        "row", F.monotonically_increasing_id()
    )
    last = F.greatest(F.lit(0), F.ceil(F.col("bytes") / chunk).cast("int") - 1)
    parts = known.withColumn("last", F.when(F.col("original").isNull(), last).otherwise(0)).select(
        "*", F.explode(F.sequence(F.lit(0), "last")).alias("no")
    )
    parts.select(_record(chunk).alias("value")).write.option("lineSep", BREAK).option(
        "compression", "gzip"
    ).text(path)


def _record(chunk: int) -> Column:
    """A record's text up to the first of the two line ends that close it."""
    revisit = F.col("original").isNotNull()
    first, final = F.col("no") == 0, F.col("no") == F.col("last")
    cut = F.substring(F.col("data"), F.col("no") * chunk + 1, F.lit(chunk)).cast("string")
    head = F.when(first & ~revisit, F.lit(HTTP_HEAD)).otherwise("")
    block = F.when(revisit, F.lit("")).otherwise(F.concat(head, cut))
    name = F.concat(
        F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")),
        F.lit(":"), F.col("row"), F.lit(">"),
    )
    kind = F.when(~first, "continuation").when(revisit, "revisit").otherwise("response")
    safe = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))

    def line(label: str, value: Column, when: Column | None = None) -> Column:
        text = F.concat(F.lit(f"{label}: "), value.cast("string"))
        return text if when is None else F.when(when, text)

    number = F.col("no") + 1
    own = F.concat(F.lit("<urn:page:part:"), F.col("row"), F.lit(":"), number, F.lit(">"))
    header = F.concat_ws(
        BREAK,
        F.lit("WARC/1.0"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", F.when(first, name).otherwise(own)),
        line("WARC-Target-URI", safe),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest"), first),
        line("X-Payload-Length", F.col("bytes"), first),
        line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("original"), F.lit(">")), revisit),
        line("WARC-Segment-Number", number, F.col("last") > 0),
        line("WARC-Segment-Origin-ID", name, ~first),
        line("WARC-Segment-Total-Length", F.col("bytes") + len(HTTP_HEAD), ~first & final),
        F.when(first, F.lit("Content-Type: application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block)),
    )
    return F.concat(header, F.lit(BREAK * 2), block, F.lit(BREAK))


class _Reader:
    """Follows the lines of archives; holds one record's header and block at a time."""

    def __init__(self) -> None:
        self.header: dict[str, str] | None = None
        self.need = -1
        self.block: list[bytes] = []
        self.have = 0

    def line(self, line: bytes) -> tuple[dict[str, str], bytes] | None:
        """Take a line (without its line feed); a header and block when a record is full."""
        if self.need >= 0:
            self.block.append(line)
            self.block.append(b"\n")
            self.have += len(line) + 1
            return self._full()
        bare = line.rstrip(b"\r")
        if self.header is None:
            if bare.startswith(b"WARC/"):
                self.header = {}
            return None
        if bare:
            label, _, value = bare.decode("utf-8", "replace").partition(":")
            self.header[label.strip().lower()] = value.strip()
            return None
        self.need, self.have, self.block = int(self.header.get("content-length", "0")), 0, []
        return self._full()

    def _full(self) -> tuple[dict[str, str], bytes] | None:
        if self.have < self.need:
            return None
        found = self.header or {}, b"".join(self.block)[: self.need]
        self.header, self.need, self.block = None, -1, []
        return found


def _page(name: str) -> int | None:
    number = name.strip("<>").removeprefix("urn:page:").split(":")[0]
    return int(number) if number.lstrip("-").isdigit() else None


def _row(header: dict[str, str], block: bytes, payload: bool) -> tuple:
    kind = header.get("warc-type", "")
    no = int(header.get("warc-segment-number", "1"))
    name = header.get("warc-segment-origin-id") or header.get("warc-record-id", "")
    if no == 1 and kind == "response" and "application/http" in header.get("content-type", ""):
        block = block[block.find(b"\r\n\r\n") + 4 :]
    single = "warc-segment-number" not in header
    length = header.get("x-payload-length")
    digest = header.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind == "response" and single:  # whole in this record: what is there counts, not what is said
        length, digest = len(block), hashlib.sha1(block).hexdigest()
    return (
        name, _page(name), header.get("warc-target-uri"), kind,
        _page(header["warc-refers-to"]) if "warc-refers-to" in header else None,
        int(length) if length is not None else None, digest, no,
        single or "warc-segment-total-length" in header,
        block if payload or not single else None,
    )


def read_chunks(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The chunk table of gzipped archives: a row per record, columns ``CHUNKS``.

    ``chunk_no`` counts from 1; continuation records carry the id of the record they
    belong to. Without ``payload`` only records in several chunks keep their bytes.
    """
    wanted = _arrow_schema()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, rows, held = _Reader(), [], 0
        for batch in batches:
            for line in batch.column(0):
                if (found := reader.line(line.as_py())) is None:
                    continue
                rows.append(_row(*found, payload))
                held += len(rows[-1][-1] or b"")
                if len(rows) >= 2000 or held > 1 << 23:
                    yield _chunk_batch(rows, wanted)
                    rows, held = [], 0
        if rows:
            yield _chunk_batch(rows, wanted)

    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("value").cast("binary").alias("line")).mapInArrow(parse, CHUNKS)


def _arrow_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in CHUNKS.split(","))])


def _chunk_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def records(chunks: DataFrame) -> DataFrame:
    """One row per record: ``page_id, payload_bytes, payload_digest, record_type, refers_to, intact``.

    A record in several chunks gets its size and digest from the chunks themselves,
    streamed in order; ``intact`` says whether they are what its header says.
    """
    kept = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    whole = chunks.filter("chunk_no = 1 AND last").select(*kept, F.lit(True).alias("intact"))
    names = ["record_id", "chunk_no", "last", "chunk", *kept]
    split = chunks.filter("chunk_no > 1 OR NOT last").select(*names)

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first, digest, size, ends, expected = None, None, None, 0, False, 1

        def done() -> pa.RecordBatch:
            found = digest.hexdigest()
            intact = ends and size == first["payload_bytes"] and found == first["payload_digest"]
            row = [first["page_id"], size, found, first["record_type"], first["refers_to"], bool(intact)]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], k) for v, k in zip(row, types, strict=True)], names=[*kept, "intact"]
            )

        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
        for batch in batches:
            for i in range(batch.num_rows):  # a chunk at a time
                row = batch.slice(i, 1).to_pylist()[0]
                if row["record_id"] != at:
                    if first:
                        yield done()
                    at, first, digest, size, expected = row["record_id"], row, hashlib.sha1(), 0, 1
                    ends = False
                digest.update(row["chunk"])
                size += len(row["chunk"])
                ends = row["last"] and row["chunk_no"] == expected
                expected += 1
        if first:
            yield done()

    carried = (
        split.repartition("record_id")
        .sortWithinPartitions("record_id", "chunk_no")
        .mapInArrow(
            carry,
            "page_id long, payload_bytes long, payload_digest string, record_type string,"
            " refers_to long, intact boolean",
        )
    )
    return whole.union(carried)
