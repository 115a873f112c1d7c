import hashlib
import random

from floorgraph.llm import warc

SCHEMA = "page_id long, url string, html string, file string, key string, digest string"


def make(spark, rows):
    return spark.createDataFrame([(i, u, h, "f", "k", "d") for i, u, h in rows], SCHEMA)


def brute(rows, least=100):
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= least:
            first[h] = min(first.get(h, i), i)
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        to = first.get(h) if len(body) >= least and i is not None and first[h] != i else None
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(map(str, out))


def pages():
    rng = random.Random(8)
    bodies = ["<p>" + "é" * 60 + "</p>", "x" * 99, "y" * 100, "short", "", None, "\r\n\r\nWARC/1.0\r\n\r\n" * 20, "z" * 300_000]
    urls = ["http://www.Example.org/a?b=1", "https://example.org:8443/", None, "", "not a url", "http://[bad", "http://exämple.de/ü x\n", "http://a.b.c/" + "p" * 3000, "a\tb", "no host\r\nhere", "http://[bad\n\tx", "http://a.b/\t\x00\x1f", "\t\n"]
    rows = [(i, rng.choice(urls), rng.choice(bodies)) for i in range(90)]
    return [*rows, rows[5], rows[5], (None, urls[0], bodies[0]), (-4, urls[1], bodies[2])]


def rows_of(df):
    return sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in df.collect())


def test_round_trip(spark):
    rows = pages()
    assert rows_of(warc.archive_round_trip(make(spark, rows))) == brute(rows)


def test_many_small_blocks_and_files(spark, monkeypatch):
    monkeypatch.setattr(warc.write_archives, "__defaults__", (100, 2000))
    monkeypatch.setattr(warc.build_capture_index, "__defaults__", (2,))
    rows = pages()
    assert rows_of(warc.archive_round_trip(make(spark, rows))) == brute(rows)


def test_empty_table(spark):
    assert warc.archive_round_trip(make(spark, [])).count() == 0


def test_sort_keys():
    assert warc.sort_key("http://www.Example.org/a?b=1") == "org,example,www)/a?b=1"
    assert warc.sort_key("https://example.org:8443/") == "org,example:8443)/"
    assert warc.sort_key(None) == "-"
    assert warc.capture_key("http://a.b/", -5) < warc.capture_key("http://a.b/", 3)


def test_one_capture_is_found_by_its_key(spark, tmp_path):
    rows = [(i, f"http://h{i % 7}.org/{i}", f"body {i}") for i in range(200)]
    captures = warc.write_archives(make(spark, rows), f"file://{tmp_path}/warc")
    index = warc.build_capture_index(captures, f"file://{tmp_path}/cdx", 16)
    asked = spark.createDataFrame([(warc.capture_key("http://h3.org/73", 73),), ("org,none)/ 1",)], "key string")
    found = warc.read_records(warc.look_up(asked, index)).collect()
    assert [(r.page_id, r.payload_digest) for r in found] == [(73, hashlib.sha256(b"body 73").hexdigest())]


def test_control_characters_in_urls_lose_no_page(spark):
    odd = ["a\tb", "a\nb", "a\rb", "http://[x\ny", "http://[x\ty", "http://h.org/\t", "\t", "\x00", "http://h\n.org/a b", " "]
    rows = [(i, u, f"body {i}") for i, u in enumerate(odd * 2)]
    assert rows_of(warc.archive_round_trip(make(spark, rows))) == brute(rows)
    assert all(c > " " for u in odd for c in warc.sort_key(u))
