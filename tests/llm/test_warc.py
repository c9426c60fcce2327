import base64
import hashlib

from sievelake.llm import warc
from sievelake.session import scratch_path

PAGES = "page_id long, url string, html string"


def digest(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def brute(pages, least):
    out, groups = [], {}
    for row in pages:
        groups.setdefault(row[2] or "", []).append(row)
    for text, rows in groups.items():
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
        for k, (page, _, _) in enumerate(rows):
            n = len(text.encode())
            first = k == 0 or n < least
            kind, refers = ("response", None) if first else ("revisit", rows[0][0])
            out.append((page, n, digest(text), kind, refers))
    return sorted(out, key=str)


TRAP = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 2\r\n\r\nxx\r\n\r\n"


def pages():
    rows = [(i, f"http://x/{i}", f"<p>{i}É</p>" * (i % 50)) for i in range(150)]
    rows += [(200 + i, "u", "same") for i in range(60)] + [(300, None, None), (301, "a\r\nb", "")]
    rows += [(400, "t", TRAP), (401, "t", "x" + TRAP * 3 + "WARC/1.0\r\n"), (402, "t", "WARC/1.0\r\n"), (403, "t", "\r\n\r\n")]
    rows += [(404, "t", "WARC/1.0\r\n\r\n\r\n" * 5), (405, "t", TRAP), (None, "t", "no id"), (406, "twice", "tw"), (406, "twice", "tw")]
    rows += [(407, "long", "0123456789" * 30000 + TRAP), (408, "t", "a\r\nContent-Length: 7\r\n\r\n")]
    return rows


def test_round_trip(spark):
    wide = spark.createDataFrame(pages(), PAGES).selectExpr("*", "1 as payload", "2 as _row")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for least, split, packed in ((0, before, "gzip"), (3, "4096", "none")):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            got = warc.round_trip(wide, least, packed).collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        rows = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got]
        assert sorted(rows, key=str) == brute(pages(), least)
    assert {r.url for r in got if r.page_id == 301} == {"a  b"}


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).collect() == []


def test_broken_files(spark):
    good = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    short = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:2>\r\nContent-Length: 99\r\n\r\nab\r\n\r\n"
    for text, pages_found in ((good + short + good, [1]), ("junk" + good, []), ("", []), ("WARC/1.0\r\nno header", [])):
        path = scratch_path(spark, "broken")
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.option("lineSep", "\n").text(path)
        got = warc.read(spark, path).where("payload_digest IS NOT NULL")
        assert [r.page_id for r in got.collect()] == pages_found
