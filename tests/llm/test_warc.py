import hashlib
from collections import Counter

import pytest

from pixelsift.llm import warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes int")


def run(spark, rows, tmp_path):
    warc.write_archive(pages(spark, [(*r, 1) for r in rows]), str(tmp_path / "w"))
    return warc.captures(spark, str(tmp_path / "w")).collect()


LONG = "<p>WARC/1.1\r\nContent-Length: 3\r\n\r\n é" + "x" * 1000


def test_captures(spark, tmp_path):
    rows = [(1, "http://a/b c\nd", LONG), (5, None, LONG), (3, "u", LONG), (2, "u", "short"), (4, "u", "short"), (6, "u", None), (7, "u", ""), (8, "u", "y" * 999), (9, "u", "y" * 999), (None, "u", LONG)]
    got = {r.page_id: r for r in run(spark, rows, tmp_path)}
    assert len(got) == len(rows)
    for i, _, html in rows:
        raw, r = (html or "").encode(), got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        revisit = html == LONG and i != 5
        assert (r.record_type, r.refers_to) == (("revisit", 5) if revisit else ("response", None))


def test_repeated_rows_and_empty_table(spark, tmp_path):
    got = run(spark, [(1, "u", LONG)] * 3 + [(2, "u", LONG)], tmp_path)
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in got) == Counter({(1, "revisit", 2): 3, (2, "response", None): 1})
    warc.write_archive(pages(spark, [(1, "u", "h", 1)]).limit(0), str(tmp_path / "e"))
    assert warc.captures(spark, str(tmp_path / "e")).count() == 0


def test_nested_rows_and_payloads(spark, tmp_path):
    warc.write_archive(pages(spark, [(1, "http://a", LONG, 1), (2, "http://b", "b", 1)]), str(tmp_path / "w"))
    rows = {r.page_id: r for r in warc.assemble(warc.read_records(spark, str(tmp_path / "w"))).collect()}
    assert bytes(rows[1].payload) == LONG.encode() and rows[1].target_uri == "http://a"
    assert len(rows[1].requests) == 1 and len(rows[1].metadata) == 1 and rows[1].metadata[0].fields[0].name == "pageId"


def test_parser():
    one = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 5\r\n\r\nab\r\nc\r\n\r\n"
    assert [b for _, b in warc.parse(one * 2)] == [b"ab\r\nc"] * 2
    with pytest.raises(ValueError):
        list(warc.parse(one[:-1]))
    import gzip

    assert warc.unzip(gzip.compress(one) + gzip.compress(one)) == one * 2 and warc.unzip(one) == one


def test_text_ids_and_large_pages(spark, tmp_path, monkeypatch):
    """Ids that are text, with line breaks in them; payloads above the bound have a file of their own."""
    monkeypatch.setattr(warc, "SMALL", 2000)
    rows = [("a\r\nb", "u", LONG), ("z%41é", "u", LONG), ("big", "u", "p" * 3_000_000), ("big2", "u", "p" * 3_000_000), (None, "u", "q")]
    warc.write_archive(spark.createDataFrame(rows, "page_id string, url string, html string"), str(tmp_path / "w"))
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.captures(spark, str(tmp_path / "w"), "string").collect()}
    assert got == {"a\r\nb": (len(LONG.encode()), "revisit", "z%41é"), "z%41é": (len(LONG.encode()), "response", None), "big": (3_000_000, "revisit", "big2"), "big2": (3_000_000, "response", None), None: (1, "response", None)}
    assert len(list((tmp_path / "w").glob("*.gz"))) >= 3
