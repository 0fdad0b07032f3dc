"""Archives against the pages they were written from."""

import base64
import gzip
import hashlib

import pyarrow as pa
from pyspark.sql import functions as F

from parlance.llm import warc
from parlance.llm.queries import op8_warc_chunks
from parlance.llm.tables import file_system

FOLDER = "/root/testdata/sf0.001"


def expected(rows):
    leaders: dict = {}
    for page, html in sorted(rows):
        leaders.setdefault(html or "", page)
    found = []
    for page, html in sorted(rows):
        data, leader = (html or "").encode(), leaders[html or ""]
        again = leader != page
        found.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                      "revisit" if again else "response", leader if again else None))
    return found


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "html").collect()]
    found = op8_warc_chunks(spark, FOLDER).orderBy("page_id").collect()
    assert [tuple(row)[:5] for row in found] == expected(rows)
    assert all(row["whole"] for row in found)


def archived(spark, rows, chunk=16):
    df = spark.createDataFrame(rows, "page_id bigint, html string").withColumn("url", F.lit("http://x\r\ny"))
    folder, manifest = warc.write_archives(warc.plan_records(df.withColumn("digest", F.lit(1))), chunk=chunk)
    return folder, manifest, warc.read_chunks(spark, folder, manifest, chunk=chunk)


def test_chunks_carry_running_digests(spark):
    text = "WARC/1.1\r\n\r\n" + "é" * 100 + "\r\n\r\n"
    rows = [(5, text), (3, text), (4, None), (9, ""), (7, "x" * 16), (8, "y" * 17)]
    folder, manifest, chunks = archived(spark, rows)
    by_record: dict = {}
    for row in chunks.collect():
        by_record.setdefault(row["record_id"], []).append(row)
    payloads = {}
    for name, pieces in by_record.items():
        pieces.sort(key=lambda row: row["chunk"])
        assert [row["last"] for row in pieces] == [False] * (len(pieces) - 1) + [True]
        assert all(len(row["payload"]) <= 16 for row in pieces)
        data = b""
        for row in pieces:
            assert row["offset"] == len(data)
            data += row["payload"]
            assert row["digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        payloads[name] = data
    assert payloads["<urn:page:3>"] == text.encode() and payloads["<urn:page:5>"] == b""
    folded = warc.chunk_records(chunks).orderBy("record_id").collect()
    got = [(int(row["record_id"][10:-1]), row["payload_bytes"], row["payload_digest"], row["record_type"],
            row["refers_to"] and int(row["refers_to"][10:-1])) for row in folded]
    assert got == expected(rows)
    system, root = file_system(folder)
    for row in manifest.collect():
        with system.open_input_stream(f"{root}/{row['file']}", compression=None) as source:
            assert gzip.decompress(source.read()).count(b"WARC-Record-ID") == row["n_records"]


def test_least_bytes_keeps_small_payloads_apart(spark):
    df = spark.createDataFrame([(1, "ab", "u"), (2, "ab", "u"), (3, "abc", None), (4, "abc", "u")], "page_id long, html string, url string")
    found = warc.plan_records(df, least_bytes=3).orderBy("page").collect()
    assert [row["record_type"] for row in found] == ["response", "response", "response", "revisit"]


def test_null_ids_and_empty_table(spark):
    _, _, chunks = archived(spark, [(None, "a"), (1, "a")])
    assert {(row["record_id"], row["record_type"]) for row in chunks.collect()} == {
        ("<urn:page:None>", "revisit"), ("<urn:page:1>", "response")}
    _, _, chunks = archived(spark, [])
    assert warc.chunk_records(chunks).collect() == []


def test_every_page_row_is_a_record(spark, tmp_path):
    rows = [
        (1, "a" * 70000), (1, "a" * 70000), (1, "other"), (2, "a" * 70000), (2, "a" * 70000), (3, "x"), (3, "y" * 140000),
        (None, "n"), (None, "n"), (None, "m" * 70000), (None, "x"), (None, None),
    ]
    df = spark.createDataFrame(rows, "page_id bigint, html string").withColumn("url", F.lit("u"))
    df.repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    found = op8_warc_chunks(spark, str(tmp_path)).collect()
    again = {(2, "a" * 70000): 1, (None, "x"): 3}
    want = []
    for page, html in rows:
        data, leader = (html or "").encode(), again.get((page, html))
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append((page, len(data), digest, "revisit" if leader else "response", leader, True))
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)


def test_a_large_record_is_read_in_pieces(tmp_path):
    data = b"z" * 5_000_000
    with open(tmp_path / "a.warc.gz", "wb") as sink:
        head = warc._header(1, "u", len(data), "D", "response", None, len(data))
        warc._write_record(sink, head, pa.py_buffer(data), 1 << 16)
    with open(tmp_path / "a.warc.gz", "rb") as source:
        stream = warc.RecordStream(source, 1 << 16)
        assert stream.header()["WARC-Type"] == "response"
        total = 0
        for piece in stream.payload(len(data)):
            total += len(piece)
            assert len(stream.held) <= 3 << 16
        assert total == len(data) and stream.header() is None
