"""The WARC archive: exact round trips, revisits, damage."""

import hashlib

import pytest
from pyspark.errors import PySparkException

from riskloom.llm import warc

LONG = "x" * 100
ROWS = [(5, "http://a.example/", LONG), (3, None, LONG), (9, "http://b.example/\r\nWARC-Type: revisit", LONG), (4, "u", "x" * 99), (1, "u", "x" * 99), (2, "u", None), (7, "u", ""),
        (8, "u v", "é\r\n\r\nWARC/1.1\r\n" * 30), (None, "u", LONG), (None, None, "n" * 200), (None, "w", "n" * 200), (6, "u", "d" * 300), (6, "u", "d" * 300), (10, "u", "long " * 300_000)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "z", 1) for r in ROWS], "page_id long, url string, html string, digest string, record int").repartition(4)


@pytest.fixture(scope="module")
def path(spark, pages, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("warc") / "archive")
    warc.archive(spark, pages, at)
    return at


def expected():
    groups = {}
    for k, _, html in ROWS:
        groups.setdefault((html or "").encode(), []).append(k)
    out = []
    for data, ids in groups.items():
        ids.sort(key=lambda k: (k is None, k or 0))
        for n, k in enumerate(ids):
            again = n > 0 and len(data) >= 100
            out.append((k, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", ids[0] if again else None))
    return sorted(out, key=str)


def test_read_back(spark, pages, path):
    found = warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r) for r in found.collect()), key=str) == expected()
    assert sorted((tuple(r) for r in warc.digest(spark, pages).collect()), key=str) == expected()


def test_payloads_are_held_once(spark, path):
    held = [(r.digest, bytes(r.payload)) for r in warc.payloads(spark, path).collect()]
    assert sorted(held) == sorted((hashlib.sha256(t).hexdigest(), t) for t in {(h or "").encode() for _, _, h in ROWS})


def test_records_are_whole(spark, path):
    """Every rebuilt record holds the length, the target and the payload of its page."""
    rebuilt = [(r.page_id, bytes(r.bytes)) for r in warc.records(spark, path).collect()]
    assert len(rebuilt) == len(ROWS)
    bodies = []
    for page, data in rebuilt:
        head, rest = data.split(b"\r\n\r\n", 1)
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        assert data.startswith(b"WARC/1.1\r\n") and rest[int(fields[b"Content-Length"]):] == b"\r\n\r\n"
        http, payload = rest[:-4].split(b"\r\n\r\n", 1)
        if fields[b"WARC-Type"] == b"response":
            assert fields[b"WARC-Payload-Digest"] == b"sha256:" + hashlib.sha256(payload).hexdigest().encode()
            bodies.append((page, payload))
        else:
            assert payload == b""
    kept = [(k, n) for k, n, _, kind, _ in expected() if kind == "response"]
    assert sorted(((k, len(b)) for k, b in bodies), key=str) == sorted(kept, key=str)


@pytest.mark.parametrize("files", [1, 3])
def test_exported_files(spark, path, tmp_path, files):
    spark.conf.set("spark.sql.shuffle.partitions", files)
    try:
        warc.export(spark, path, str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    back = warc.parse(spark.read.format("binaryFile").load(str(tmp_path / "out" / "part-*"))).collect()
    assert sorted(bytes(r.warc) + bytes(r.http) + bytes(r.payload) + b"\r\n\r\n" for r in back) == sorted(bytes(r.bytes) for r in warc.records(spark, path).collect())


def test_damage_is_found(spark, pages, tmp_path):
    at, bad = str(tmp_path / "a"), str(tmp_path / "b")
    warc.archive(spark, pages, at)
    held = spark.read.schema(warc.PAYLOADS).parquet(f"{at}/payloads")
    held.selectExpr("digest", "case when length(payload) = 99 then cast('y' as binary) else payload end as payload").write.parquet(f"{bad}/payloads")
    spark.read.schema(warc.RECORDS).parquet(f"{at}/records").write.parquet(f"{bad}/records")
    with pytest.raises(PySparkException, match="damaged payload"):
        warc.read(spark, bad).collect()


def test_missing_payload_is_found(spark, pages, tmp_path):
    at, bad = str(tmp_path / "a"), str(tmp_path / "b")
    warc.archive(spark, pages, at)
    spark.read.schema(warc.PAYLOADS).parquet(f"{at}/payloads").where("length(payload) <> 99").write.parquet(f"{bad}/payloads")
    spark.read.schema(warc.RECORDS).parquet(f"{at}/records").write.parquet(f"{bad}/records")
    with pytest.raises(PySparkException, match="damaged record"):
        warc.read(spark, bad).collect()


def test_empty_table(spark, pages):
    assert warc.digest(spark, pages.limit(0)).collect() == []
