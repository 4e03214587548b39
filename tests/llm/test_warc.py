"""Archives: exact round trips."""

import gzip
import hashlib

import pyarrow.fs

from tilewright.llm import warc
from tilewright.llm.common import shared_path

SCHEMA = "page_id long, url string, html string, id long, chunk_no int, payload string"


def test_round_trip(spark):
    long = "é漢x" * 200_000
    pages = [(5, "http://a b", long), (3, "u", long), (9, None, "y" * 100), (1, "u", "y" * 100), (2, "u", "short"), (4, "u", "short"), (6, "u", None), (7, "u", ""), (None, "u", "y" * 100), (3, "u", long), (8, "u", "\r\n\r\nWARC/1.1\r\n" * 20)]
    df = spark.createDataFrame([(*p, 1, 2, "z") for p in pages], SCHEMA)
    folder = shared_path(spark, "warc")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df, size=1000, folder=folder).collect()), key=repr)
    want = []
    for i, _, t in pages:
        b = (t or "").encode()
        first = min((j for j, _, u in pages if j is not None and (u or "") == (t or "")), default=None)
        revisit = len(b) >= 100 and first is not None and first != i
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=repr)
    fs, path = pyarrow.fs.FileSystem.from_uri(folder)
    raw = b"".join(gzip.decompress(fs.open_input_stream(f.path).read()) for f in fs.get_file_info(pyarrow.fs.FileSelector(path)))
    assert raw.count(b"WARC-Type: response") == sum(w[3] == "response" for w in want) and long.encode() in raw
    assert warc.round_trip(df.limit(0)).count() == 0


def test_chunks_carry_digests(spark):
    df = spark.createDataFrame([(1, "u", "a" * 2500, 1, 2, "z")], SCHEMA)
    made = warc.write(warc.records(warc.chunk_table(df, size=1000)), shared_path(spark, "warc"))
    rows = sorted(warc.read(made, 1000).collect(), key=lambda r: r.chunk_no)
    assert [r.n_bytes for r in rows] == [1000, 1000, 500] and [r.last for r in rows] == [False, False, True]
    assert [r.sha256 for r in rows] == [hashlib.sha256(b"a" * n).hexdigest() for n in (1000, 2000, 2500)]
    assert b"".join(bytes(r.data) for r in rows) == b"a" * 2500


def test_a_large_payload_travels_in_chunks(spark):
    """No row after the first scan is larger than a chunk."""
    text = "0123456789abcdef" * (1 << 20)
    df = spark.createDataFrame([(1, "u", text, 1, 2, "z"), (2, "u", text, 1, 2, "z")], SCHEMA)
    rows = warc.records(warc.chunk_table(df)).selectExpr("id", "refers_to", "chunk_no", "octet_length(data) AS n", "last").collect()
    assert {r.n for r in rows if r.id == 1} == {warc.CHUNK} and len([r for r in rows if r.id == 1]) == len(text) // warc.CHUNK
    assert [(r.refers_to, r.chunk_no, r.n, r.last) for r in rows if r.id == 2] == [(1, 0, 0, True)]
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type) for r in warc.round_trip(df).collect()}
    digest = hashlib.sha256(text.encode()).hexdigest()
    assert got == {1: (len(text), digest, "response"), 2: (len(text), digest, "revisit")}


def test_stores_by_the_names_of_clusters(tmp_path):
    assert warc.SCHEMES["s3a"] == "s3" and warc.opened(f"file://{tmp_path}")[1] == str(tmp_path)


def test_records_stay_whole_where_partitions_are_skewed(spark):
    """With thresholds at which adaptive execution takes a payload of many chunks for a skewed partition."""
    keys = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1m", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.0", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k", "spark.sql.files.maxPartitionBytes": "1m"}
    before = {k: spark.conf.get(k, None) for k in keys}
    text = "".join(hashlib.sha256(str(k).encode()).hexdigest() for k in range(150_000))
    pages = [(1, "u", text)] + [(k, "u", text[: 64 * k] + ("same" * 100 if k % 2 else str(k) * 50)) for k in range(2, 40)] + [(k, "u", "same" * 200) for k in range(50, 90)]
    df = spark.createDataFrame([(*p, 1, 2, "z") for p in pages], SCHEMA)
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        got = {r.page_id: r for r in warc.round_trip(df, size=1 << 12).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert {i: (r.payload_bytes, r.payload_digest) for i, r in got.items()} == {i: (len(t), hashlib.sha256(t.encode()).hexdigest()) for i, _, t in pages}
    assert {i for i, r in got.items() if r.record_type == "revisit"} == set(range(51, 90))
