"""Url rules and WARC bundles against brute force."""

import hashlib
from collections import Counter

from pyspark.sql import functions as F

from assay.llm import warc
from assay.llm.url_rules import judge, rule_table
from assay.llm.warc import parse_records, read_bundles, read_record, record_bytes, records, write_bundles
from assay.session import scratch_path

URLS = [
    None, "", "no scheme", "http://", "http://COM/", "https://A.Example.com/en/x?q#f", "http://www.example.com/en/", "http://x.www.example.com/en/a",
    "http://example.com/en", "ftp://notexample.com/en/", "http://u@b.net/es/1", "http://b.net/fr/", "http://b.net?x/fr/", "http://b.net./fr/", "x://y://z/en/",
    "http://example.com#f", "http://a\nb.net/es/\n", "http://é.com/en/", "http://" + "a." * 200 + "example.com/en/" + "p" * 3000,
]
RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"),
    ("block", "example.com", "/"), ("allow", "example.com", "/"), ("block", "example.com", "/en/x"), ("allow", "z", ""), ("block", "net", "/es/1"),
]
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def judged(url, rules, default="allow"):
    if not url or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:end].translate(ASCII), rest[end:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, default))
    return host, path, best[2], best[3]


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, row long, suffix string, key string")


def test_rules(spark):
    rows = [(i, u, None, None, "x", "y") for i, u in enumerate(URLS)] + [(None, URLS[5], "", 1, "", ""), (5, URLS[5], "", 1, "", "")]
    for rules in (RULES, RULES[:5], []):
        got = Counter(map(tuple, judge(pages_of(spark, rows), rule_table(spark, rules)).collect()))
        assert got == Counter((r[0], *judged(r[1], rules)) for r in rows)
    assert judge(pages_of(spark, []), rule_table(spark, RULES)).count() == 0


def test_records_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 1000)
    long = "<p>é</p>" * 50
    rows = [(i, u, h, 1, "", "") for i, (u, h) in enumerate([
        ("http://a/", long), ("http://b/\r\nX: y", long), (None, long), ("http://c/", None), ("http://d/", ""), ("http://e/", "x" * 99), ("http://f/", "x" * 99),
        ("http://g/", "y" * 100), ("http://h/", "y" * 100), ("http://i/", "\r\n\r\nWARC/1.1\r\n" * 3000),
    ])]
    rows += [(None, "http://n/", long, 1, "", ""), (None, None, "z" * 200, 1, "", ""), (None, None, "z" * 200, 1, "", ""), rows[0], rows[1]]
    folder = scratch_path(spark, "bundles")
    index = write_bundles(records(pages_of(spark, rows)), folder)
    got = Counter(map(tuple, read_bundles(spark, folder, index).drop("url").collect()))
    firsts = {}
    for i, _, h, *_ in rows:
        if i is not None:
            firsts[h or ""] = min(firsts.get(h or "", i), i)
    want = Counter()
    for i, _, h, *_ in rows:
        data = (h or "").encode()
        again = len(data) >= 100 and firsts.get(h or "") not in (None, i)
        want[i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", firsts[h or ""] if again else None] += 1
    assert got == want
    for r in index.collect():
        head, _, payload = read_record(folder, r.bundle, r.frame, r.offset, r.length)
        assert head["WARC-Record-ID"] == f"<urn:page:{'' if r.page_id is None else r.page_id}>"
        assert len(payload) in (0, len((rows[r.page_id or 0][2] or "").encode()), 200)


def test_bundles_are_plain_zstandard(spark):
    import glob

    import zstandard

    folder = scratch_path(spark, "bundles")
    write_bundles(records(pages_of(spark, [(1, "http://a/", "text" * 100, 0, "", "")])), folder)
    (name,) = glob.glob(f"{folder.removeprefix('file:')}/*.warc.zst")
    with open(name, "rb") as file:
        raw = zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True).read()
    ((head, http, payload),) = parse_records(raw)
    assert head["WARC-Type"] == "response" and http["Content-Length"] == "400" and payload == b"text" * 100


def test_bundles_are_read_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 1000)
    folder = scratch_path(spark, "bundles")
    rows = [(i, f"http://a/{i}", f"{i} " * 400, 0, "", "") for i in range(60)]
    read = read_bundles(spark, folder, write_bundles(records(pages_of(spark, rows).repartition(4)), folder))
    tasks = Counter(r.task for r in read.select("page_id", F.spark_partition_id().alias("task")).collect())
    assert sum(tasks.values()) == 60 and len(tasks) > 4


def test_no_pages(spark):
    folder = scratch_path(spark, "bundles")
    index = write_bundles(records(pages_of(spark, [])), folder)
    assert index.count() == 0 and read_bundles(spark, folder, index).count() == 0


def test_a_record_as_text():
    row = {"page_id": 3, "url": "http://a/ b", "html": "hi", "record_type": "revisit", "refers_to": 1, "payload_digest": "00"}
    raw = record_bytes(row)
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: revisit\r\n") and b"WARC-Target-URI: http://a/%20b\r\n" in raw and raw.endswith(b"\r\n\r\n\r\n\r\n")
