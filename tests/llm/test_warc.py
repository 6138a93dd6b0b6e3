import hashlib

import pytest

from framewright.llm import op1_warc as w

SCHEMA = "page_id bigint, url string, html string, file string, key string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def expected(rows):
    """By the rule, in plain Python."""
    payload = [(i, (h or "").encode()) for i, _, h in rows]
    out = []
    for i, p in payload:
        ids = [j for j, q in payload if q == p and j is not None]
        first = min(ids) if ids and len(p) >= 100 else None
        revisit = first is not None and i != first
        digest = hashlib.sha256(p).hexdigest()
        out.append((i, len(p), digest, "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


ROWS = [
    (3, "http://A.example.com/x?q=1#f", "c" * 100),
    (1, "http://b.example.com/\r\nInjected: yes", "c" * 100),
    (None, "http://b.example.com/", "c" * 100),
    (2, None, "c" * 99),
    (4, "no scheme", "c" * 99),
    (5, "http://a.example.com/ü", None),
    (6, "", ""),
    (7, "http://a.example.com/long", "é\r\n\r\n" * 60_000),
    (7, "http://a.example.com/long", "é\r\n\r\n" * 60_000),
    (None, "http://n.example.com/", "n" * 200),
]


def test_round_trip(spark):
    directory, folder = w.archive(pages(spark, ROWS))
    found = sorted(map(tuple, w.read_all(directory, folder).collect()), key=str)
    assert found == expected(ROWS)


def test_empty_table(spark):
    directory, folder = w.archive(pages(spark, []))
    assert w.read_all(directory, folder).collect() == []


def test_look_up_reads_blocks_by_bisection(spark):
    rows = [(i, f"http://h{i % 7}.example.org/p/{i}", f"page {i}") for i in range(300)]
    folder = w.shared_path(spark, "warc")
    directory = w.write_index(w.write_archives(pages(spark, rows), folder), folder, block_lines=10)
    assert directory.count() >= 30
    asked = [rows[17][1], rows[230][1], "http://h1.example.org/none"]
    assert sorted(r[0] for r in w.look_up(directory, folder, asked).collect()) == [17, 230]


def test_damage_is_noticed():
    whole = w.record(1, "http://a/", b"payload", None)
    assert w.parse_record(whole)[:2] == (1, 7)
    import gzip

    with pytest.raises(ValueError):
        w.parse_record(gzip.compress(gzip.decompress(whole).replace(b"payload", b"pay1oad")))


def test_keys_reverse_hosts():
    assert w.url_key("https://user@www.Example.com:80/a?b#c") == "com,example,www)/a?b"
    assert w.url_key(None) == ""
