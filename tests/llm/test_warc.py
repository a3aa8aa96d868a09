import base64
import gzip
import hashlib

from helpers import rows_of

from groundwork.llm import warc as w

PAGES = [(1, "http://a/ü?x=1", "<p>one</p>"), (2, "http://b/", None), (3, None, ""), (4, "http://c/\r\nX: y", "<p>one</p>"), (5, "", "ü" * 100_000), (0, "u", "<p>one</p>"),
         (6, "http://d/", "WARC/1.1\r\n\r\nnot a header\r\n\r\n"), (7, "x", "two"), (7, "x", "two"), (None, "n", "<p>one</p>"), (8, "x", "two")]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, refers_to string")


def plain(rows):
    first = {}
    for k, _, html in rows:
        if k is not None:
            first[html or ""] = min(k, first.get(html or "", k))
    out = []
    for k, _, html in rows:
        data = (html or "").encode()
        later = k is not None and first[html or ""] < k
        out.append((k, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if later else "response", first[html or ""] if later else None, None))
    return sorted(out, key=repr)


NAMES = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "fault")


def test_round_trip_whatever_the_ranges(spark):
    files = w.write(w.revisits(pages(spark)), w.folder(spark))
    for size in (7, 100, 1 << 20):
        assert rows_of(w.read(files, size), *NAMES) == plain(PAGES)
    html = {(r["page_id"], bytes(r["payload"])) for r in w.read(files).collect() if r["record_type"] == "response"}
    assert html == {(k, (h or "").encode()) for (k, _, h), p in zip(PAGES, PAGES) if (k, "response") in {(x[0], x[3]) for x in plain(PAGES)}}


def test_files_are_gzip_archives(spark):
    files = w.write(w.revisits(pages(spark)), w.folder(spark), file_bytes=300).collect()
    assert sum(f["records"] for f in files) == len(PAGES)
    whole = b"".join(gzip.open(f["path"].removeprefix("file:")).read() for f in files)
    assert whole.count(b"WARC-Record-ID") == len(PAGES) and b"\r\nX: y" not in whole


def test_small_payloads_are_never_revisits(spark):
    files = w.write(w.revisits(pages(spark), min_bytes=5), w.folder(spark))
    kinds = {r["page_id"]: r["record_type"] for r in w.read(files).collect()}
    assert kinds[3] == "response" and kinds[8] == "response" and kinds[4] == "revisit"


def test_damaged_members_are_rows_with_a_fault(spark, tmp_path):
    a, b, c = (w.record(k, "u", b"payload %d " % k * 50, None) for k in (1, 2, 3))
    bad = b[:-8] + bytes([b[-8] ^ 255]) + b[-7:]
    path = tmp_path / "x.warc.gz"
    path.write_bytes(b"junk\x1f\x8b\x08junk" + a + bad + gzip.compress(b"no warc") + c[:len(c) // 2])
    files = spark.createDataFrame([(str(path), path.stat().st_size, 0)], w.FILES)
    got = {r["page_id"]: r["fault"] for r in w.read(files, 50).collect()}
    assert got[1] is None and got[2] == "broken off" and got[3] == "broken off"
    other = w.record(9, "u", b"abc", None)
    assert w.parse(gzip.decompress(other).replace(b"abc", b"abd"), True)[-1] == "digest"


def test_empty_table(spark):
    files = w.write(w.revisits(pages(spark, [])), w.folder(spark))
    assert files.count() == 0 and w.read(files).count() == 0
