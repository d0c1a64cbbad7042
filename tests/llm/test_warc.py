import base64
import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from pipescope.llm import warc

PAGES = "page_id long, url string, html string, payload string, record_type int"


def brute(rows):
    payloads = [(p, (h or "").encode()) for p, _, h, *_ in rows]
    out = []
    for p, data in payloads:
        last = None
        if len(data) >= 1000 and sum(d == data for _, d in payloads) > 1:
            last = max((q for q, d in payloads if d == data and q is not None), default=None)
        revisit = last is not None and last != p
        out.append((p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", last if revisit else None))
    return sorted(out, key=str)


def test_round_trip_equals_a_brute_count(spark, tmp_path):
    body = "é\r\n\r\nWARC/1.1\r\n" * 90
    rows = [(1, "http://a.org/x y\n", body, "c", 1), (2, "http://a.org/", body, "c", 1), (9, None, body, "c", 1), (3, "u", None, "c", 1),
            (4, "u", "", "c", 1), (5, "u", "short", "c", 1), (6, "u", "short", "c", 1), (6, "u", "short", "c", 1), (None, "u", body, "c", 1),
            (7, "u", "z" * 3_000_000, "c", 1), (8, "u", "w" * 1000, "c", 1), (8, "u", "w" * 1000, "c", 1)]
    got = warc.archive_round_trip(spark.createDataFrame(rows, PAGES), str(tmp_path / "w"))
    found = got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted((tuple(r) for r in found), key=str) == brute(rows)
    whole = {r.page_id: bytes(r.payload) for r in warc.read_archives(spark, str(tmp_path / "w")).where("record_type = 'response'").collect()}
    assert whole[7] == b"z" * 3_000_000 and whole[9] == body.encode() and whole[3] == b""
    headers = warc.read_archives(spark, str(tmp_path / "w"), warc.HEADERS_SCHEMA)
    assert headers.where(F.col("page_id").isin(5, 9)).count() == 2
    assert headers.where("page_id = 1").first()["target_uri"] == "http://a.org/x%20y%0A"
    revisits = headers.where(F.col("record_type") == "revisit")
    above_scan = revisits._jdf.queryExecution().executedPlan().toString().split("BatchScan")[0]
    assert "= revisit" not in above_scan and revisits.count() == 3


def test_payloads_that_are_not_wanted_are_not_inflated():
    records = [warc.record({"page_id": i, "url": "u", "record_type": "response", "refers_to": None, "payload_digest": "00" * 20,
                            "payload_bytes": 0, "payload": bytes(range(256)) * 4000}) for i in range(3)]

    class Counting(io.BytesIO):
        taken = 0

        def read(self, size=-1):
            out = super().read(size)
            self.taken += len(out)
            return out

    stream = Counting(b"".join(warc.member(r, 0) for r in records))
    rows = list(warc.read_records(stream, 0, len(stream.getvalue()), lambda r: r["page_id"] == 2, True))
    assert [r["page_id"] for r in rows] == [2] and rows[0]["payload"] == bytes(range(256)) * 4000
    assert stream.taken < 2.3e6  # of 3 MB: the headers of all, the payload of one
    plain = io.BytesIO(b"".join(gzip.compress(r) for r in records))  # members without lengths are read through
    assert len(list(warc.read_records(plain, 0, len(plain.getvalue()), lambda r: True, False))) == 3


def test_empty_table(spark, tmp_path):
    assert warc.archive_round_trip(spark.createDataFrame([], PAGES), str(tmp_path / "w")).count() == 0


def foreign(kind, block, *headers):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", *headers, f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def test_archives_of_other_writers(spark, tmp_path):
    """One record a member, many records a member, members with names, and this writer's files in one folder."""
    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n"
    sha = hashlib.sha1(b"body").digest()
    records = [
        foreign("warcinfo", b"software: x\r\n"), foreign("response", http + b"body" * 100_000, "WARC-Payload-Digest: sha1:" + sha.hex().upper()),
        foreign("response", http + b"WARC/1.0\r\n\r\n", "WARC-Payload-Digest: sha1:" + base64.b32encode(sha).decode().lower(), "X-Page-ID: seven"),
        foreign("metadata", b"", "WARC-Payload-Digest: md5:00"), foreign("revisit", http, "WARC-Payload-Digest: sha1:short", "X-Page-ID: 7")]
    folder = tmp_path / "w"
    warc.write_archives(warc.records_of(spark.createDataFrame([(1, "u", "own", "c", 1)], PAGES)), str(folder))
    (folder / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    (folder / "b.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    with gzip.GzipFile(folder / "c.warc.gz", "wb") as named:  # the member has the file's name
        named.write(b"".join(records[:2]))
    (folder / ("part-" + "0" * 32 + ".warc.gz")).write_bytes(b"left by a failed attempt")
    rows = warc.read_archives(spark, str(folder)).collect()
    assert len(rows) == 1 + 5 + 5 + 2
    large = [r for r in rows if r.payload and len(r.payload) == 400_000]
    assert len(large) == 3 and {r.payload_digest for r in large} == {sha.hex()}
    assert sum(bytes(r.payload or b"") == b"WARC/1.0\r\n\r\n" and r.payload_digest == sha.hex() and r.page_id is None for r in rows) == 2
    assert sum(r.record_type == "revisit" and r.payload is None and r.payload_digest is None and r.page_id == 7 for r in rows) == 2
    assert sum(bytes(r.payload or b"") == b"software: x\r\n" for r in rows) == 3
    assert warc.read_archives(spark, str(folder / "b.warc.gz"), warc.HEADERS_SCHEMA).where("record_type = 'response'").count() == 2
    for name, data in (("d.warc.gz", gzip.compress(records[1])[:-400]), ("e.warc", records[0]), ("f.warc.gz", gzip.compress(b"no archive\r\n\r\n"))):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(Exception, match="archive|gzip|record"):
            warc.read_archives(spark, str(tmp_path / name)).collect()
