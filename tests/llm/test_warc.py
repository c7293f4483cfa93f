import base64
import hashlib
import random
import time

import pytest
from evidex.llm import warc as W


def test_round_trip_with_and_without_dictionary():
    rng = random.Random(1)
    bodies = [b"", b"x", bytes(rng.randbytes(300)), "é\r\n\r\nü".encode() * 50, b"<html><p>common words</p></html>" * 400] * 40
    records = [W.record(W.RESPONSE, i, "http://a/é", hashlib.sha256(b).hexdigest(), len(b), b) for i, b in enumerate(bodies)]
    for dictionary in (b"", W.train_dictionary([r + rng.randbytes(2000) for r in records], 4096)):
        archive = W.write_archive(records, dictionary)
        assert [W.parse(r)[1] for r in W.frames(archive)] == bodies
    assert dictionary


def test_broken_archives_are_refused():
    good = W.record(W.RESPONSE, 1, "u", hashlib.sha256(b"abc").hexdigest(), 3, b"abc")
    archive = W.write_archive([good])
    for bad in (b"", archive[8:], archive[:-3], archive + b"junk", W.skippable(b"")[:6], archive[:20] + b"\x00" + archive[21:]):
        with pytest.raises(W.WarcError):
            list(W.frames(bad))
    for bad in (good.replace(b"Content-Length: 3", b"Content-Length: 4"), good.replace(b"WARC/1.1", b"HTTP/1.1"), good.replace(b"abc", b"abd"), good.replace(b"WARC-Date", b"WARC-Type"), good.replace(b"WARC-Date: ", b"WARC-Date ")):
        with pytest.raises(W.WarcError):
            W.parse(bad)


def brute(rows):
    out, first = [], {}
    for i, _, t in rows:
        b = (t or "").encode()
        if len(b) >= 100:
            first[b] = min(first.get(b, i), i)
    done = set()
    for i, _, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        low = first.get(b, i)
        again = low != i or (len(b) >= 100 and b in done)
        done.add(b)
        out.append((str(i), len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", str(low) if again else None))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_write_and_read_back(spark, tmp_path):
    rng = random.Random(2)
    bodies = [None, "", "short", "ü" * 50, "x" * 99, "y" * 100, "<p>" * 5000]
    rows = [(i, rng.choice([None, "http://h/\r\nx"]), rng.choice(bodies)) for i in range(80)]
    for data in (rows, rows + rows[:9]):
        pages = spark.createDataFrame(data, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS id", "3 AS payload")
        archives = W.write(pages, archive_bytes=20_000)
        back = W.read(archives)
        assert rows_of(back) == brute(data)
        assert {bytes(r.block) for r in back.collect() if r.record_type == "response"} == {(b or "").encode() for b in {r[2] for r in data}}
    assert archives.count() > 1
    for n, r in enumerate(archives.collect()):
        (tmp_path / f"{n}.warc.zst").write_bytes(r.archive)
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert rows_of(W.read(files, "content")) == brute(data)


def test_empty_and_null_ids(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert W.read(W.write(none)).collect() == []
    nulls = spark.createDataFrame([(None, None, "a" * 200), (None, None, "a" * 200), (5, None, "a" * 200)], "page_id long, url string, html string")
    assert sorted(r.record_type for r in W.read(W.write(nulls)).collect()) == ["response", "revisit", "revisit"]


def foreign(kind, block, *more):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:0f>", "WARC-Date: 2024-01-01T00:00:00Z", *more, f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_archives_of_other_writers(spark):
    body = b"<p>body</p>" * 20
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    sha1, sha256 = base64.b32encode(hashlib.sha1(body).digest()).decode(), hashlib.sha256(body)
    kind = "Content-Type: application/http; msgtype=response"
    records = [
        foreign("warcinfo", b"software: x\r\n"),
        foreign("request", b"GET / HTTP/1.1\r\n\r\n", "WARC-Concurrent-To: <urn:uuid:1>", "WARC-Concurrent-To: <urn:uuid:2>"),
        foreign("response", http, "WARC-Target-URI: http://a/", kind, f"WARC-Payload-Digest: sha1:{sha1}", f"WARC-Block-Digest: md5:{hashlib.md5(http).hexdigest()}"),
        foreign("revisit", b"", f"WARC-Payload-Digest: sha256:{base64.b32encode(sha256.digest()).decode().rstrip('=')}", "WARC-Refers-To: <urn:uuid:0f>"),
        foreign("metadata", b"a: b", "X-Folded: one\r\n two"),
    ]
    archive = W.write_archive(records)
    archive = archive[: W.frame_end(memoryview(archive), 8)] + W.skippable(b"a note") + archive[W.frame_end(memoryview(archive), 8) :]
    got = W.read(spark.createDataFrame([(archive,), (None,)], "archive binary")).collect()
    assert [tuple(r)[:6] for r in got] == [("urn:uuid:0f", "http://a/", "response", len(body), sha256.hexdigest(), None), ("urn:uuid:0f", "", "revisit", None, sha256.hexdigest(), "urn:uuid:0f")]
    for bad in (foreign("response", http, kind, f"WARC-Payload-Digest: sha1:{sha1[::-1]}"), foreign("metadata", b"a", f"WARC-Block-Digest: sha1:{sha1}")):
        with pytest.raises(W.WarcError):
            W.parse(bad)


def test_reading_takes_time_in_proportion():
    rng = random.Random(3)
    records = [foreign("resource", rng.randbytes(1000)) for _ in range(30_000)]
    archive = W.write_archive(records)
    begin = time.perf_counter()
    assert sum(1 for _ in W.frames(archive)) == 30_000
    assert time.perf_counter() - begin < 5


def test_very_long_and_repeated_rows_without_ids(spark):
    rows = [(None, None, "a" * 3_000_000)] * 3 + [(4, "u", None)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = rows_of(W.read(W.write(pages)))
    assert sorted(r[1:4:2] for r in got) == [(0, "response")] * 2 + [(3_000_000, "response")] + [(3_000_000, "revisit")] * 2
