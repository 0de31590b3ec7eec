"""WARC archives: writing gzip members record by record, and a splittable reader that finds records within byte ranges."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacewing.llm.common import BROADCAST_ROWS, PRE, cut, ensure_checkpoint_dir, likely

#: Bytes of an archive that one task scans, and that are read from it at a time; bytes of a candidate that must decode to a record's header.
SPLIT, READ, PROBE = 32 << 20, 1 << 20, 4096
#: Payloads shorter than this are never replaced by revisit records.
LEAST_REVISIT = 1000
_MAGIC = b"\x1f\x8b\x08"

RECORD = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("target_uri", T.StringType()),
    T.StructField("refers_to", T.StringType()), T.StructField("payload_digest", T.StringType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload", T.BinaryType()),
])


def _clean(value: str) -> str:
    """A header's value without line ends."""
    return re.sub(r"[\r\n]+", " ", value)


def member_of(record_id: str, kind: str, uri: str | None, payload: bytes, length: int, digest: str, refers_to: str | None) -> bytes:
    """One record as a gzip member of its own. A revisit has the HTTP header, with the full payload's length, but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    lines += [f"WARC-Target-URI: {_clean(uri)}"] if uri is not None else []
    lines += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if refers_to else []
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join([*lines, "", ""]).encode() + block + b"\r\n\r\n") + packer.flush()


def parse(record: bytes) -> dict:
    """A decoded record as a row of RECORD; a response's digest and length are those of the payload read, a revisit's those its headers state."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    http, _, payload = rest[: int(fields.get("Content-Length", 0))].partition(b"\r\n\r\n")
    kind = fields.get("WARC-Type")
    stated = re.search(rb"\r\nContent-Length: (\d+)", http)
    if kind == "revisit":
        digest, length, payload = fields.get("WARC-Payload-Digest", "").removeprefix("sha1:"), int(stated[1]) if stated else None, None
    else:
        digest, length = hashlib.sha1(payload).hexdigest(), len(payload)
    refers_to = fields.get("WARC-Refers-To", "").strip("<>") or None
    return {"record_id": fields.get("WARC-Record-ID", "").strip("<>"), "record_type": kind, "target_uri": fields.get("WARC-Target-URI"), "refers_to": refers_to, "payload_digest": digest, "payload_bytes": length, "payload": payload}


class _Window:
    """Bytes of a file from a place on, read piece by piece and given back when passed."""

    def __init__(self, file, at: int, size: int):
        self.file, self.begin, self.size, self.data = file, at, size, b""

    def upto(self, end: int) -> bool:
        """Make bytes before `end` available, or as far as the file goes."""
        while self.begin + len(self.data) < min(end, self.size):
            self.file.seek(self.begin + len(self.data))
            more = self.file.read(READ)
            if not more:
                return False
            self.data += more
        return True

    def forget(self, at: int) -> None:
        if at > self.begin:
            self.data, self.begin = self.data[at - self.begin :], at


def _inflate(window: _Window, at: int, most: int | None = None) -> tuple[bytes, int | None]:
    """Decoded member that begins at `at`, and where it ends; None instead of the end if it is cut short by `most`. zlib.error if it is no member."""
    unpacker, parts, held = zlib.decompressobj(31), [], 0
    while not unpacker.eof:
        window.upto(at + 1)
        piece = window.data[at - window.begin :]
        if not piece:
            raise zlib.error("file ends within a member")
        parts.append(unpacker.decompress(piece, (most - held) if most else 0))
        held += len(parts[-1])
        at += len(piece) - len(unpacker.unused_data) - len(unpacker.unconsumed_tail)
        if most is None:
            window.forget(at)
        elif held >= most and not unpacker.eof:
            return b"".join(parts), None
    return b"".join(parts), at


def _valid(window: _Window, at: int) -> bool:
    """Whether a record's member begins at `at`: its gzip header is sound, and what it decodes to begins as a record does."""
    window.upto(at + 10)
    head = window.data[at - window.begin : at - window.begin + 4]
    if len(head) < 4 or head[:3] != _MAGIC or head[3] & 0xE0:
        return False
    try:
        return _inflate(window, at, PROBE)[0].startswith(b"WARC/1.")
    except zlib.error:
        return False


def records_within(file, begin: int, end: int, size: int) -> Iterator[bytes]:
    """Decoded records whose members begin within [begin, end) of a file.

    The first is looked for by gzip's magic bytes, of which candidates must prove sound; from it on, each member tells where the next
    begins. The last one may reach beyond the end. Damaged members are passed over to the next sound one.
    """
    window, at, known = _Window(file, begin, size), begin, False
    while at < min(end, size):
        if not known:
            window.upto(at + READ)
            found = window.data.find(_MAGIC, at - window.begin)
            if found < 0:
                at = max(at + 1, window.begin + len(window.data) - 2)
                window.forget(at)
                if at >= size - 3:
                    return
                continue
            at = window.begin + found
            if at >= end:
                return
            window.forget(at)
            if not _valid(window, at):
                at += 1
                continue
        try:
            record, after = _inflate(window, at)
        except zlib.error:
            at, known = max(at, window.begin) + 1, False
            continue
        yield record
        at, known = after, True
        window.forget(at)
        window.upto(at + 4)
        known = window.data.startswith(_MAGIC)


def write_warc(pages: DataFrame, folder: str) -> None:
    """Write rows (record_id, uri, kind, digest, length, refers_to, payload binary) to one archive a partition in a folder all machines share.

    A task writes under a name of its attempt's own and renames it when done, so a task that is run again, after a loss or speculatively,
    replaces the archive by an equal one.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, (store, path) = TaskContext.get(), fs.FileSystem.from_uri(folder)
        name = f"{path}/part-{context.partitionId():06d}"
        draft = f"{name}.{context.taskAttemptId()}.tmp"
        with store.open_output_stream(draft) as out:
            for batch in batches:
                for row in zip(*[batch.column(c) for c in ("record_id", "kind", "uri", "payload", "length", "digest", "refers_to")], strict=True):
                    record_id, kind, uri, payload, *rest = [x.as_py() for x in row]
                    out.write(member_of(record_id, kind, uri, payload or b"", *rest))
        store.move(draft, f"{name}.warc.gz")
        yield pa.RecordBatch.from_pydict({"written": [name]})

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path)
    pages.select("record_id", "kind", "uri", "payload", "length", "digest", "refers_to").mapInArrow(write, "written string").foreach(_pass)


def _pass(_) -> None:
    """The rows say only that the archives are written."""


def read_warc(spark: SparkSession, folder: str, split: int = SPLIT, payloads: bool = True) -> DataFrame:
    """Records (RECORD) of all archives in a folder, wherever a split falls. payloads=False leaves the payloads out after digesting them.

    The archives' byte ranges are the rows that Spark deals out, a range a task or so; each record belongs to the range in which its member begins.
    """
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "length")
    begins = F.explode(F.sequence(F.lit(0), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split).cast("bigint"))).alias("begin")
    ranges = archives.where("length > 0").select("path", "length", begins)
    n = max(1, ranges.count())
    ranges = ranges.repartition(n, "path", "begin")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(f.name, {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[f.dataType.simpleString()]) for f in RECORD])
        for batch in batches:
            for path, length, begin in zip(*[batch.column(c).to_pylist() for c in ("path", "length", "begin")], strict=True):
                store, name = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_file(name) as file:
                    for record in records_within(file, begin, begin + split, length):
                        row = parse(record)
                        if not payloads:
                            row["payload"] = None
                        rows.append(row)
                        held += 500 + len(row["payload"] or b"")
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return ranges.mapInArrow(read, RECORD)


def revisits(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """Rows for write_warc(): of records with equal payloads of at least LEAST_REVISIT bytes, that with the largest id is the response.

    Null html counts as empty; null ids are smaller than any; rows that share the largest id are all responses; a null url gives no target.
    Digests are reduced to those of several rows; payloads are shuffled only to be joined with very many of these, and then only those that may be shared.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("string").alias("id"), F.col(id_col).alias("n"), F.col(url_col).alias("uri"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "length": F.octet_length("payload").cast("long")})
    shared = rows.where(f"length >= {LEAST_REVISIT}").groupBy("digest").agg(F.max("n").alias("top"), F.count("*").alias("m")).where("m > 1 and top is not null")
    shared = cut(shared.select("digest", "top"))
    if shared.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(shared), "digest", "left")
    else:  # payloads of digests that surely aren't shared stay where they are
        marked = rows.withColumn(PRE + "again", likely(shared, "digest"))
        alone = marked.where(f"not {PRE}again").withColumn("top", F.lit(None).cast(shared.schema["top"].dataType))
        rows = marked.where(PRE + "again").join(shared, "digest", "left").unionByName(alone).drop(PRE + "again")
    again = F.col("top").isNotNull() & ~F.col("n").eqNullSafe(F.col("top"))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("")))
    return rows.select(
        name(F.col("n")).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("kind"), "uri", "payload", "length", "digest", F.when(again, name(F.col("top"))).alias("refers_to")
    )


def archive(pages: DataFrame, folder: str | None = None) -> str:
    """Write pages to archives and give the folder's name, a new one below the shared folder unless given; a name without a scheme is one of the
    cluster's own file system, as for Spark."""
    spark = pages.sparkSession
    folder = folder or f"{ensure_checkpoint_dir(spark)}/{PRE}warc-{uuid.uuid4()}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    folder = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    write_warc(revisits(pages), folder)
    return folder


ORACLE = f"""
with p as (select page_id, sha1(coalesce(html, '')) as digest, strlen(coalesce(html, '')) as size from pages),
q as (select *, case when size >= {LEAST_REVISIT} then max(page_id) over (partition by digest, size) end as top from p)
select page_id, size::bigint as payload_bytes, digest as payload_digest, case when page_id < top then 'revisit' else 'response' end as record_type,
       case when page_id < top then top end as refers_to
from q"""
