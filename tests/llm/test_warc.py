import base64
import hashlib

import pytest

from tridelta.llm import warc
from tridelta.session import scratch_path

PAGES = [(1, "http://a/x", "<p>same</p>"), (2, None, "<p>same</p>"), (3, "http://a/y\r\nInjected: 1", "<p>é\r\n\r\nWARC/1.1\r\n\r\n</p>"),
         (4, "http://b/", None), (5, "http://b/", ""), (6, "http://b/z", "x" * 200_000), (7, "u", "<p>same</p>"), (7, "u", "<p>same</p>"),
         (None, "n", "none"), (None, "n", "<p>same</p>")]
SCHEMA = "page_id bigint, url string, html string, id int, payload string, type int, value int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", 2, 3) for r in rows], SCHEMA)


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(rows, min_bytes=0):
    out = []
    for i, _, h in rows:
        same = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        last = max(same, default=None) if len((h or "").encode()) >= min_bytes else None
        revisit = last is not None and i != last
        out.append((str(i), len((h or "").encode()), digest(h), "revisit" if revisit else "response", str(last) if revisit else "None"))
    return sorted(out)


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_round_trip(spark, min_bytes):
    caps = warc.round_trip(spark, frame(spark, PAGES), min_bytes=min_bytes)
    got = sorted(tuple(str(r[c]) if c in ("id", "refers_to") else r[c] for c in
                       ("id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
                 for r in warc.capture_table(caps).collect())
    assert got == expected(PAGES, min_bytes)


def test_records_hold_the_blocks_and_digests(spark):
    path = scratch_path(spark, "w")
    warc.write_archive(warc.plan_captures(frame(spark, PAGES[:6]), "page_id", "url", "html"), path, records_per_file=4)
    recs = warc.read_records(spark, path).collect()
    assert len(recs) == 18 and {r.type for r in recs} == {"request", "response", "revisit", "metadata"}
    for r in recs:
        if r.type == "response":
            head, _, payload = bytes(r.block).partition(b"\r\n\r\n")
            assert head.startswith(b"HTTP/1.1 200") and r.payload_digest == r.computed_digest == digest(payload.decode())
            assert r.payload_bytes == len(payload) and r.block_bytes == len(r.block)
    assert any("%0D%0AInjected" in (r.target_uri or "") for r in recs)


def test_assembly_takes_links_from_either_side(spark):
    row = {"refers_to": None, "target_uri": None, "payload_digest": None, "block_bytes": 0, "payload_bytes": 0,
           "computed_digest": "", "block": b""}
    recs = [dict(row, type="response", record_id="r1", concurrent_to=["q1"]), dict(row, type="request", record_id="q1", concurrent_to=[]),
            dict(row, type="metadata", record_id="m1", concurrent_to=["r1"]), dict(row, type="metadata", record_id="m2", concurrent_to=["r1"]),
            dict(row, type="response", record_id="r2", concurrent_to=[]), dict(row, type="request", record_id="q2", concurrent_to=["r2"]),
            dict(row, type="warcinfo", record_id="i", concurrent_to=[])]
    df = spark.createDataFrame(recs, warc.RECORD_FIELDS)
    got = {r.record_id: ([q.record_id for q in r.requests], [m.record_id for m in r.metadata]) for r in warc.assemble(df).collect()}
    assert got == {"r1": (["q1"], ["m1", "m2"]), "r2": (["q2"], [])}


def test_broken_archives_fail():
    good = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    assert [bytes(b) for _, b in warc.parse_records(good * 2)] == [b"ab", b"ab"]
    import gzip

    assert len(list(warc.parse_records(gzip.compress(good) + gzip.compress(good)))) == 2
    for bad in (good[:-3], b"x" + good, good.replace(b"h: 2", b"h: 1"), gzip.compress(good)[:-6]):
        with pytest.raises((ValueError, KeyError)):
            list(warc.parse_records(bad))


def test_empty_table(spark):
    assert warc.capture_table(warc.round_trip(spark, frame(spark, []))).count() == 0


def record(k, body):
    return b"WARC/1.1\r\nWARC-Record-ID: r%d\r\nContent-Length: %d\r\n\r\n" % (k, len(body)) + body + b"\r\n\r\n"


@pytest.mark.parametrize("piece", [1, 7, 64, 1 << 20])
def test_archives_are_walked_piece_by_piece(monkeypatch, piece):
    import gzip

    monkeypatch.setattr(warc, "PIECE", piece)
    bodies = [b"", b"\r\n\r\n", b"WARC/1.1\r\n\r\n", b"x" * 3000, b"ab" * 500, b"\x1f\x8b", b"last"]
    one = [record(k, b) for k, b in enumerate(bodies)]
    for data in (b"".join(one), gzip.compress(b"".join(one)), b"".join(map(gzip.compress, one))):
        got = [(h["warc-record-id"], bytes(b)) for h, b in warc.parse_records(data)]
        assert got == [([f"r{k}"], b) for k, b in enumerate(bodies)]
    assert list(warc.parse_records(b"")) == list(warc.parse_records(gzip.compress(b""))) == []
    with pytest.raises(ValueError):
        list(warc.parse_records(gzip.compress(one[0]) + b"rest"))


def test_a_file_is_never_inflated_whole():
    import gzip
    import tracemalloc

    data = b"".join(gzip.compress(record(k, b"page " * 100_000)) for k in range(60))  # 30 MB of blocks
    whole = gzip.compress(gzip.decompress(data))
    for archive in (data, whole):
        tracemalloc.start()
        assert sum(len(b) for _, b in warc.parse_records(archive)) == 30_000_000
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 8 << 20


def test_long_pages_make_more_files(spark):
    pages = frame(spark, [(k, "u", "x" * 1000) for k in range(40)] + [(100, "u", None)])
    assert warc.file_records(pages, "html", file_bytes=10_000) == 30
    assert warc.file_records(pages, "html") == 30_000 and warc.file_records(frame(spark, []), "html") == 30_000
    assert warc.file_records(pages, "html", file_bytes=1) == 3
