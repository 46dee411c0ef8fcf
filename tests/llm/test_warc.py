"""WARC archives: exact round trips through the text source, and the reader fed in any pieces."""

import base64
import gzip
import glob
import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strata.llm.warc import Reader, chunk_rows, read_archives, warc_round_trip, write_archives

CASES = [
    (1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (9, None, "<p>x</p>"), (3, "http://a/\r\nX: y", None),
    (4, "", ""), (5, "http://é/ü", "é" * 700), (6, "u", "a\r\n\r\nb\r\n\r\n\r\n"), (7, "u", "\r\n"), (8, "u", "\r\n\r\n"),
    (10, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n"), (11, "u", "long " * 50_000), (12, "u", "long " * 50_000),
    (None, "u", "<p>x</p>"), (None, "u", "nobody's"), (13, "u", "twice"), (13, "u", "twice"), (14, "u", "\r"), (14, "u", "\n\r\n\r"),
]


def plain(rows, min_bytes=0):
    latest = {}
    for i, _, html in rows:
        if i is not None:
            latest[html or ""] = max(i, latest.get(html or "", i))
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        keep = latest.get(html or "") if len(data) >= min_bytes else i
        refers = None if i == keep else keep
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((i, len(data), digest, "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk_bytes", [7, 1 << 20])
@pytest.mark.parametrize("min_bytes", [0, 6])
def test_round_trip(spark, chunk_bytes, min_bytes):
    rows = [(*r, "x", 1) for r in CASES if chunk_bytes > 100 or len(r[2] or "") < 5000]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, uid int").repartition(3)
    got = sorted((tuple(r) for r in warc_round_trip(pages, min_bytes=min_bytes, chunk_bytes=chunk_bytes).collect()), key=str)
    assert got == plain([r[:3] for r in rows], min_bytes)
    assert warc_round_trip(pages.limit(0)).count() == 0


def test_archives_are_plain_warc_files(spark, tmp_path):
    rows = [r for r in CASES if r[0] in (5, 11)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    write_archives(pages, str(tmp_path / "w"), chunk_bytes=1000)
    whole = b"".join(gzip.open(f).read() for f in sorted(glob.glob(str(tmp_path / "w" / "part-*.gz"))))
    heads = []
    while whole:
        head, _, rest = whole.partition(b"\r\n\r\n")
        heads.append(dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:]))
        length = int(heads[-1]["Content-Length"])
        assert rest[length : length + 4] == b"\r\n\r\n"
        whole = rest[length + 4 :]
    segments = [h for h in heads if h["WARC-Type"] == "continuation"]
    assert [h["WARC-Type"] for h in heads].count("response") == 2
    assert len(segments) == 1 + 249
    assert sorted(tuple(r) for r in read_archives(spark, str(tmp_path / "w")).collect()) == sorted(plain(rows))


def record(payload: bytes, name: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload)
    digest = base64.b32encode(hashlib.sha1(payload).digest())
    return (
        b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%s>\r\nWARC-Payload-Digest: sha1:%s\r\n"
        b"X-Running-Digest: sha1:%s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n"
    ) % (name.encode(), digest, digest, len(http) + len(payload), http + payload)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab\r\n", max_size=30), max_size=5), st.integers(1, 40))
def test_reader_takes_any_pieces(payloads, step):
    data = b"".join(record(p.encode(), str(i)) for i, p in enumerate(payloads))
    reader = Reader()
    got = [row for at in range(0, len(data), step) for row in reader.feed(data[at : at + step])]
    assert [(r[0], r[1]) for r in got] == [(i, len(p)) for i, p in enumerate(payloads)]


def test_damage_is_noticed():
    data = record(b"payload", "1").replace(b"payload", b"paylaod")
    with pytest.raises(ValueError, match="damaged"):
        list(Reader().feed(data))


@given(st.binary(max_size=50), st.integers(1, 9))
def test_chunks_carry_digests(payload, size):
    rows = list(chunk_rows(payload, size))
    assert b"".join(r[1] for r in rows) == payload
    assert all(len(r[1]) <= size for r in rows)
    for n, (number, _, running) in enumerate(rows):
        assert number == n
        assert running == base64.b32encode(hashlib.sha1(payload[: (n + 1) * size]).digest()).decode()
