import base64
import gzip
import hashlib

import duckdb
import pytest

from quillspark.llm import warc
from quillspark.llm.warc import Part, digest_of, key_of, lookup, parse, read_archives, record, url_key, write_archives

URLS = [None, "", "http://A.example.com/x?Q=1", "https://b.example.com/", "example.org/é 1\r\nWARC-Type: fake", "http://h", "ftp://x.y.z:80/p#f"]


def brute(rows, least=0):
    groups = {}
    for i, _, html, *_ in rows:
        groups.setdefault(html or "", []).append(i)
    out = []
    for i, _, html, *_ in rows:
        data = (html or "").encode()
        top = max((x for x in groups[html or ""] if x is not None), default=None)
        revisit = len(data) >= least and len(groups[html or ""]) > 1 and top is not None and i != top
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    return out


key = lambda r: tuple((x is None, x) for x in r)


@pytest.mark.parametrize("least", [0, 10])
@pytest.mark.parametrize("entries", [1, 3, 512])
def test_round_trip(spark, tmp_path, least, entries):
    html = [None, "", "<p>é</p>", "<p>same page</p>", "x" * 100_000, "a\r\n\r\nb"]
    rows = [(i, URLS[i % len(URLS)], html[i % 6 if i < 40 else 3], "c") for i in range(60)] + [(60, "http://h", "only", "c"), (None, "http://n", "<p>same page</p>", "c"), (None, "http://n", "no id", "c"), (59, URLS[1], html[3], "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, key string").repartition(3)
    directory = write_archives(pages, str(tmp_path / "w"), least=least, entries=entries)
    kind = pages.schema["page_id"].dataType
    got = read_archives(directory, kind, payloads=True).collect()
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(brute(rows, least), key=key)
    text = {(i, h or "") for i, _, h, _ in rows}
    assert all((r.page_id, bytes(r.payload).decode()) in text for r in got if r.record_type == "response")
    listed = sorted(directory.collect(), key=lambda r: (r.part, r.block))
    assert [r.first_key for r in listed] == sorted(r.first_key for r in listed)
    for wanted in ([], ["http://not.there/"], [URLS[3], None, URLS[3]], [*URLS, "http://not.there/"]):
        keys = {key_of(u) for u in wanted}
        want = [b for b, r in zip(brute(rows, least), rows, strict=True) if key_of(r[1]) in keys]
        found = lookup(directory, spark.createDataFrame([(u,) for u in wanted], "url string"), kind).collect()
        assert sorted(map(tuple, found), key=key) == sorted(want, key=key)
    archive = open(listed[0].archive, "rb").read()
    assert gzip.decompress(archive).startswith(b"WARC/1.0\r\nWARC-Type: ")


def test_keys_agree(spark):
    got = spark.createDataFrame([(u,) for u in URLS], "u string").select("u", url_key("u").alias("k")).collect()
    assert all(r.k == key_of(r.u) for r in got)
    assert key_of("http://a.Example.com/P?q") == "com,example,a)/p?q"


IDS = ["", None, "a b", "a\r\nWARC-Type: fake", "-", ">", "x>y", "<urn:page:1>", "%41", "A", "é\u2028", "1" * 300]


def test_any_id_comes_back(spark, tmp_path):
    rows = [(i, f"http://h/{n % 3}", "same" if n % 2 else f"own {n}") for n, i in enumerate(IDS)]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string").repartition(2)
    directory = write_archives(pages, str(tmp_path / "w"), entries=2)
    got = read_archives(directory, pages.schema["page_id"].dataType).collect()
    assert sorted((tuple(r) for r in got), key=key) == sorted(brute(rows), key=key)
    found = lookup(directory, pages.select("url"), pages.schema["page_id"].dataType).collect()
    assert sorted((r.page_id for r in found), key=lambda i: (i is None, i or "")) == sorted(IDS, key=lambda i: (i is None, i or ""))


def test_a_lookup_reads_the_blocks_that_may_hold_its_key(spark, tmp_path):
    rows = [(i, f"http://host{i // 10:03d}.example/", f"page {i}") for i in range(1000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    directory = write_archives(pages, str(tmp_path / "w"), entries=7).collect()
    for n in {r.part for r in directory}:
        blocks = [r for r in directory if r.part == n]
        for k in sorted({key_of(u) for _, u, _ in rows}) + ["", "zzz", "example,host0005)/"]:
            part = Part(*(blocks[0][c] for c in ("archive", "index", "sparse")))
            got = list(part.captures(k))
            holding = sum(b.first_key <= k <= b.last_key for b in blocks)
            assert len(got) <= 10 and part.blocks_read <= holding + 1 <= 4
    whole = [r.page_id for r in lookup(spark.createDataFrame(directory), pages.where("page_id % 100 = 0"), pages.schema["page_id"].dataType).collect()]
    assert sorted(whole) == [i for i in range(1000) if i // 10 % 10 == 0]


def test_blocks_are_bounded_in_bytes(spark, tmp_path):
    """Pages of 20 MB have a block each; small ones share blocks of the limit."""
    pages = spark.range(6).selectExpr("id AS page_id", "concat('http://big.example/', id) AS url", "concat(id, repeat('0123456789 abcdefghi', 1000000)) AS html")
    pages = pages.unionByName(spark.range(100, 1100).selectExpr("id AS page_id", "'http://small.example/' AS url", "concat(id, repeat('x', 10000)) AS html"))
    directory = write_archives(pages.repartition(2), str(tmp_path / "w"), entries=10_000, block_bytes=1_000_000)
    rows = directory.collect()
    assert all(r.entries == 1 for r in rows if r.last_key.startswith("example,big"))
    assert max(r.entries for r in rows) <= 101
    got = read_archives(directory, pages.schema["page_id"].dataType).selectExpr("page_id", "payload_bytes", "payload_digest").collect()
    assert sorted((r.page_id, r.payload_bytes) for r in got) == [(i, 20_000_001) for i in range(6)] + [(i, 10_000 + len(str(i))) for i in range(100, 1100)]


def test_most_rows_with_one_id(spark, tmp_path):
    """Half of the rows share id and URL: they are dealt out by their digests, and every record keeps its own type."""
    rows = [(None if i % 2 else i, "http://one.example/" if i % 2 else f"http://h/{i}", f"page {i % 400}") for i in range(2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    directory = write_archives(pages, str(tmp_path / "w"))
    per_part = {}
    for r in directory.collect():
        per_part[r.part] = per_part.get(r.part, 0) + r.entries
    assert max(per_part.values()) < 900
    got = read_archives(directory, pages.schema["page_id"].dataType).collect()
    assert sorted((tuple(r) for r in got), key=key) == sorted(brute(rows), key=key)


def test_lookup_against_sql(spark, tmp_path):
    rows = [(i, URLS[i % 7] if i % 3 else f"http://a.b/{i % 50}", [None, "", "x", f"y{i}"][i % 4]) for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    directory = write_archives(pages, str(tmp_path / "w"), entries=5)
    got = lookup(directory, pages.where("page_id % 20 = 0"), pages.schema["page_id"].dataType).select("page_id", "payload_bytes", "record_type", "refers_to").collect()
    pages = pages.toPandas()  # noqa: F841
    assert sorted(map(tuple, got), key=key) == sorted(duckdb.sql(warc.lookup_oracle()).fetchall(), key=key)


def test_damage_is_found():
    member = record("1", "u", b"payload")
    assert parse(member).payload == b"payload"
    bad = gzip.compress(gzip.decompress(member).replace(b"payload\r\n\r\n", b"paXload\r\n\r\n"))
    with pytest.raises(ValueError, match="digest"):
        parse(bad)
    assert digest_of(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"


def test_empty(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert read_archives(write_archives(pages, str(tmp_path / "w")), pages.schema["page_id"].dataType).collect() == []


def test_sql_of_the_query(spark, tmp_path):
    html = [None, "", "<p>é</p>", "same", "same", "x" * 5000]
    pages = spark.createDataFrame([(i, URLS[i % len(URLS)], html[i * 7 % 6]) for i in range(40)], "page_id long, url string, html string")
    pages.write.parquet(str(tmp_path / "pages"))
    got = read_archives(write_archives(pages, str(tmp_path / "w")), pages.schema["page_id"].dataType)
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages/*.parquet'")
        want = db.sql(warc.oracle())
        assert want.columns == got.columns
        assert sorted(want.fetchall(), key=key) == sorted(map(tuple, got.collect()), key=key)
