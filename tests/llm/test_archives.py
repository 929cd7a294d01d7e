import base64
import gzip
import hashlib

import pytest

from skiplight.llm import archives as A
from skiplight.llm.queries import QUERIES


def sha(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_arc_versions():
    blocks = [b"", b"line\nhttp://fake 1.1.1.1 2 text/html 9\n", b"\n\n", b"HTTP/1.1 200 OK\r\n\r\nbody"]
    for version in (1, 2):
        data = A.arc_opening(version, "x.arc", "20240101000000") + b"\n" + b"\n".join(A.arc_record(version, {"URL": f"http://h/{i}", "IP-address": "1.2.3.4", "Archive-date": "2024", "Content-type": "text/html", "Result-code": "200"}, b) for i, b in enumerate(blocks)) + b"\n"
        got = list(A.parse_arc(data))
        assert [b for *_, b, _ in got] == blocks and [f["URL"] for _, _, f, *_ in got] == [f"http://h/{i}" for i in range(4)]
        assert all(v == version and data[at:].startswith(b"http://h/") for at, v, *_ in got)
        assert (got[0][2].get("Result-code") == "200") == (version == 2)
        with pytest.raises(ValueError, match="cut off"):
            list(A.parse_arc(data[:-5]))
    for bad in (b"http://h 1.1.1.1 2024 text/html 0\n", b"nonsense", A.arc_opening(1, "x", "2024").replace(b"1 0 skip", b"7 0 skip")):
        with pytest.raises(ValueError):
            list(A.parse_arc(bad))


def test_damaged_archives_are_read_on(spark, tmp_path):
    head = {"IP-address": "1.2.3.4", "Archive-date": "2024", "Content-type": "text/html"}
    one, two, three = (A.arc_record(1, {"URL": u, **head}, b) for u, b in (("http://h/a b  c", b"<p>one</p>"), ("http://h/2", b"two"), ("http://h/3", b"three")))
    data = A.arc_opening(1, "x.arc", "2024") + b"\n" + one + b"\nhttp://broken 1 2\nhtml of it\n" + two + b"\n" + three[:-2]
    got = list(A.parse_arc(data, keep_damaged=True))
    assert [(f.get("URL"), b, e is None) for _, _, f, b, e in got] == [("http://h/a b  c", b"<p>one</p>", True), (None, b"", False), ("http://h/2", b"two", True), (None, b"", False)]
    assert data[got[1][0] :].startswith(b"http://broken") and "cut off" in got[3][4]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.arc.gz").write_bytes(gzip.compress(data))
    (tmp_path / "a" / "y.arc").write_bytes(b"not an archive\n")
    errors = A.convert_arcs(spark, str(tmp_path / "a"), str(tmp_path / "w")).collect()
    assert sorted((r["file"], r["offset"]) for r in errors) == [("x.arc.gz", got[1][0]), ("x.arc.gz", got[3][0]), ("y.arc", 0)]
    assert sorted(r["url"] for r in A.read_warcs(spark, str(tmp_path / "w")).collect()) == ["http://h/2", "http://h/a b  c"]


def test_dates_and_urls():
    assert A.iso_date("20240229123456") == "2024-02-29T12:34:56Z" and A.iso_date("2024") == "2024-01-01T00:00:00Z" and A.iso_date("-") == "1970-01-01T00:00:00Z"
    assert A.safe_url(None) == A.safe_url("") == "unknown:" and A.safe_url("http://a b\n\xa0") == "http://a%20b%0A%C2%A0"


def test_warc_records_keep_any_bytes():
    blocks = [bytes(range(256)), b"\r\n\r\nWARC/1.1\r\n", b""]
    data = b"\r\n\r\n".join(A.warc_record({"WARC-Type": "resource"}, b) for b in blocks) + b"\r\n\r\n"
    assert [b for _, b in A.parse_warc(data)] == blocks
    with pytest.raises(ValueError):
        list(A.parse_warc(data[:200]))


def test_query(spark, tmp_path):
    odd = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n\nfiledesc://x 1\n"
    rows = [(1, "http://a/1", "<p>same</p>"), (9, "http://a/9", "<p>same</p>"), (4, "http://a/4", "<p>same</p>"), (2, None, None), (3, "http://b c/é", ""), (5, "http://a/1", odd), (6, "http://d", "é日" * 5), (6, "http://d", "é日" * 5), (None, "http://n", "null id"), (8, "http://l", "x" * 3_000_000)]
    spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS record", "1 AS offset", "'y' AS digest").repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    got = QUERIES["op4_arc_to_warc"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    best = {}
    for i, _, h in rows:
        k = (h or "").encode()
        best[k] = max(best.get(k, -1), -1 if i is None else i)
    texts = {i: (h or "").encode() for i, _, h in rows}
    for r in got:
        data = texts[r["page_id"]]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), sha(data))
        if r["record_type"] == "response":
            assert r["refers_to"] is None and (r["page_id"] is None or best[data] == r["page_id"])
        else:
            assert r["refers_to"] == best[data]
    assert sum(r["record_type"] == "response" for r in got) == len(best)
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "e" / "pages.parquet"))
    assert QUERIES["op4_arc_to_warc"](spark, str(tmp_path / "e")).collect() == []


@pytest.mark.parametrize("version", [1, 2])
def test_files_are_archives(spark, tmp_path, version):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "same" if i < 6 else f"p{i}") for i in range(20)], "page_id long, url string, html string").repartition(2)
    A.write_arcs(pages, str(tmp_path / "a"), version=version)
    A.convert_arcs(spark, str(tmp_path / "a"), str(tmp_path / "w"), least_bytes=5)
    seen = []
    for f in sorted((tmp_path / "w").glob("part-*")):
        records = list(A.parse_warc(gzip.decompress(f.read_bytes())))
        assert records[0][0]["warc-type"] == "warcinfo"
        seen += records[1:]
    assert len(seen) == 20 and len({h["warc-record-id"] for h, _ in seen}) == 20
    assert all(h["warc-type"] == "response" and h["warc-date"] == "2024-01-01T00:00:00Z" for h, _ in seen)  # 'same' is shorter than 5 bytes
    A.convert_arcs(spark, str(tmp_path / "a"), str(tmp_path / "v"))
    rows = A.read_warcs(spark, str(tmp_path / "v")).collect()
    assert sorted(r["page_id"] for r in rows if r["record_type"] == "revisit") == [0, 1, 2, 3, 4]
    first = next(r for r in rows if r["page_id"] == 5)
    assert {r["refers_to_id"] for r in rows if r["record_type"] == "revisit"} == {first["record_id"]} and first["payload"] == b"same"
