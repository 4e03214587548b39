"""WARC archives through a table of chunks.

Payloads are cut to rows (record, chunk number, bytes) as they are read, and written as a table; from there on no row is larger than a chunk. They are streamed into
gzip members by the writing tasks, and streamed back by the reading tasks with a SHA-256 that is carried from chunk to chunk. Only the first scan sees a payload
in one piece, as its table holds it in one value. A task's archive has a name of its own, and only the archives that Spark's writer has committed to
the manifest are read, so attempts that were lost or repeated leave nothing behind that counts.

Of records with equal payloads of at least `least` bytes, the one with the smallest id is a response and the others are
revisits of it; rows that repeat that smallest id are responses too. Rows with a null id come after all others, and are
responses where no other row has the payload. Null payloads are empty, and shorter ones are all responses. An empty
table gives no rows. Other columns do not take part, whatever their names. A null url is written as an empty one.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.llm.common import lean, saved, shared_path

CHUNK = 1 << 18
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LINE = b"\r\n"


def chunk_table(pages: DataFrame, *, id_col: str = "page_id", url: str = "url", payload: str = "html", size: int = CHUNK) -> DataFrame:
    """(_row, id, url, payload_bytes, payload_digest, chunk_no, last, data): the rows' payloads cut to chunks as they are read, written as a table. An empty payload is one empty chunk."""
    body = F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b""))
    own = pages.select(F.monotonically_increasing_id().alias("_row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{url}`").alias("url"), body.alias("payload"))
    own = own.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    n = F.greatest(F.lit(1), F.ceil(F.col("payload_bytes") / size)).cast("int")
    cut = own.withColumn("_n", n).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    rows = cut.select("_row", "id", "url", "payload_bytes", "payload_digest", "chunk_no", (F.col("chunk_no") == F.col("_n") - 1).alias("last"), F.substring("payload", F.col("chunk_no") * size + 1, F.lit(size)).alias("data"))
    return saved(rows, "chunks")


def records(chunks: DataFrame, *, least: int = 100) -> DataFrame:
    """chunks with `refers_to` (the response's id, for revisits, which keep one empty chunk), a record's side by side and in order.

    Which rows are revisits is told by ids and digests alone; chunks are then joined by the number of their row, so that no payload that many rows share is one
    task's.
    """
    heads = chunks.filter("chunk_no = 0").select("_row", "id", "payload_bytes", "payload_digest").filter(F.col("payload_bytes") >= least)
    firsts = heads.groupBy("payload_digest").agg(F.min("id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    revisits = heads.join(firsts.hint("merge"), "payload_digest").filter(~F.col("id").eqNullSafe(F.col("_first")) & F.col("_first").isNotNull()).select("_row", F.col("_first").alias("refers_to"))
    # Dealt by a given number of partitions, which adaptive execution takes as they are: it would split large ones of its own, and a record with them.
    n = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = chunks.repartition(n, "_row").join(revisits.hint("merge"), "_row", "left").filter(F.col("refers_to").isNull() | (F.col("chunk_no") == 0))
    again = F.col("refers_to").isNotNull()
    out = met.withColumns({"data": F.when(again, F.lit(b"")).otherwise(F.col("data")), "last": again | F.col("last")})
    return out.sortWithinPartitions("_row", "chunk_no").select("id", "url", "payload_bytes", "payload_digest", "refers_to", "chunk_no", "last", "data")


#: Names that clusters give to stores, and those by which pyarrow knows them.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def opened(uri: str) -> tuple[pa.fs.FileSystem, str]:
    scheme, colon, rest = uri.partition(":")
    return pa.fs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + colon + rest)


def name_of(x: object) -> str:
    return f"<urn:record:{'' if x is None else x}>"


def header(r: dict) -> bytes:
    """A record's WARC header, blank line and HTTP header."""
    revisit = r["refers_to"] is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r['payload_bytes']}\r\n\r\n".encode()
    url = " ".join((r["url"] or "").split())
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name_of(r['id'])}", "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha256:{r['payload_digest']}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {name_of(r['refers_to'])}"]
    lines.append(f"Content-Length: {len(http) + (0 if revisit else r['payload_bytes'])}")
    return "\r\n".join(lines).encode() + LINE * 2 + http


def write(chunks: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Writes chunk rows as archives of one gzip member a record, below folder (any place that pyarrow.fs opens). Returns their manifest (archive, records)."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = opened(folder)
        fs.create_dir(path, recursive=True)
        name, out, n = f"{uuid.uuid4().hex}.warc.gz", None, 0
        for b in batches:
            for r in (r for k in range(0, b.num_rows, 16) for r in b.slice(k, 16).to_pylist()):
                if out is None:
                    out = fs.open_output_stream(f"{path}/{name}")
                if r["chunk_no"] == 0:
                    member = zlib.compressobj(level, zlib.DEFLATED, 31)
                    out.write(member.compress(header(r)))
                out.write(member.compress(r["data"]))
                if r["last"]:
                    out.write(member.compress(LINE * 2) + member.flush())
                    n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "records": pa.array([n], pa.int64())})

    return saved(chunks.mapInArrow(lean(written), "archive string, records long"), "manifest")


class Inflated:
    """Bytes of a stream of gzip members, read piece by piece."""

    def __init__(self, source, size: int = 1 << 16) -> None:
        self.source, self.size, self.member, self.have, self.rest = source, size, zlib.decompressobj(31), bytearray(), b""

    def more(self) -> bool:
        if self.member.eof:
            self.rest, self.member = self.member.unused_data, zlib.decompressobj(31)
        raw = self.member.unconsumed_tail or self.rest or self.source.read(self.size)
        self.rest = b""
        if not raw:
            return False
        self.have += self.member.decompress(raw, 1 << 20)
        return True

    def line(self) -> bytes | None:
        while (at := self.have.find(LINE)) < 0:
            if not self.more():
                return None
        out = bytes(self.have[:at])
        del self.have[: at + 2]
        return out

    def take(self, most: int) -> bytes:
        while len(self.have) < most and self.more():
            pass
        out = bytes(self.have[:most])
        del self.have[:most]
        return out


def fields(stream: Inflated) -> dict[str, str]:
    out = {}
    while line := stream.line():
        k, _, v = line.decode().partition(":")
        out[k.strip().lower()] = v.strip()
    return out


CHUNKS = T.StructType([T.StructField(n, t) for n, t in (
    ("archive", T.StringType()), ("record_no", T.LongType()), ("record_id", T.StringType()), ("record_type", T.StringType()), ("url", T.StringType()), ("refers_to", T.StringType()),
    ("declared_digest", T.StringType()), ("declared_bytes", T.LongType()), ("chunk_no", T.LongType()), ("n_bytes", T.LongType()), ("sha256", T.StringType()), ("last", T.BooleanType()), ("data", T.BinaryType()))])


def read(manifest: DataFrame, size: int = CHUNK, payload: bool = True) -> DataFrame:
    """Chunk rows of archives: (archive, record_no, record_id, ..., chunk_no, n_bytes, sha256 of the payload up to here, last, data).

    A record without payload has one empty chunk. data is null if no payload is asked for; it is read and digested all the same.
    """

    def chunks(archive: str) -> Iterator[dict]:
        fs, path = opened(archive)
        with fs.open_input_stream(path) as source:
            stream, number = Inflated(source), -1
            while (line := stream.line()) is not None:
                if not line:
                    continue
                if not line.startswith(b"WARC/"):
                    raise ValueError(f"{archive}: no record starts with {line[:40]!r}")
                head, number = fields(stream), number + 1
                left = int(head["content-length"])
                status = stream.line()
                http = fields(stream)
                left -= len(status) + 4 + sum(len(k) + len(v) + 4 for k, v in http.items())
                digest, k = hashlib.sha256(), 0
                about = {"archive": archive, "record_no": number, "record_id": head["warc-record-id"], "record_type": head["warc-type"], "url": head["warc-target-uri"], "refers_to": head.get("warc-refers-to"), "declared_digest": head["warc-payload-digest"].removeprefix("sha256:"), "declared_bytes": int(http["content-length"])}
                while k == 0 or left:
                    data = stream.take(min(size, left))
                    if len(data) < min(size, left):
                        raise ValueError(f"{archive}: record {number} is cut short")
                    digest.update(data)
                    left -= len(data)
                    yield about | {"chunk_no": k, "n_bytes": len(data), "sha256": digest.hexdigest(), "last": not left, "data": data if payload else None}
                    k += 1

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, rows, held = to_arrow_schema(CHUNKS), [], 0
        for b in batches:
            for archive in b.column(0).to_pylist():
                for r in chunks(archive):
                    rows.append(r)
                    held += 500 + (r["n_bytes"] if payload else 0)
                    if held > 1 << 23:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    # One archive a task: an archive is the output of one task, and so of bounded size.
    n = manifest.count()
    # Dealt in turn from one list of names, so that each task gets one.
    return manifest.select("archive").coalesce(1).repartition(max(1, n)).mapInArrow(lean(of), CHUNKS)


def round_trip(pages: DataFrame, *, id_col: str = "page_id", url: str = "url", payload: str = "html", least: int = 100, size: int = CHUNK, folder: str | None = None) -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to) of each row, as read back from archives that it has written."""
    made = write(records(chunk_table(pages, id_col=id_col, url=url, payload=payload, size=size), least=least), folder or shared_path(pages.sparkSession, "warc"))
    id_type = pages.schema[id_col].dataType
    bare = lambda c: F.when(F.length(c) > 13, F.substring(c, 13, F.length(c) - 13)).cast(id_type)
    revisit = F.col("record_type") == "revisit"
    wrong = F.col("last") & ~revisit & ((F.col("sha256") != F.col("declared_digest")))
    ends = read(made, size, payload=False).withColumn("sha256", F.when(wrong, F.raise_error(F.concat(F.lit("digest differs: "), "record_id"))).otherwise(F.col("sha256"))).filter("last")
    total = F.when(revisit, F.col("declared_bytes")).otherwise(F.col("chunk_no") * size + F.col("n_bytes"))
    return ends.select(bare(F.col("record_id")).alias(id_col), total.alias("payload_bytes"), F.when(revisit, F.col("declared_digest")).otherwise(F.col("sha256")).alias("payload_digest"), "record_type", bare(F.col("refers_to")).alias("refers_to"))
