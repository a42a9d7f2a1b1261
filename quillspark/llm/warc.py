"""WARC archives with a two-level capture index.

Records are written in the order of their reversed-host URL keys, each a gzip member of its own. The index lists the
captures in the same order, in compressed blocks of at most ENTRIES captures and about BLOCK_BYTES of payload; beside it,
a sparse directory keeps the first key of each block and where it is. A lookup finds the parts whose range of keys holds
a key, and in each task of the search halves the part's directory, reads the blocks that may hold the key, and then the
byte ranges of its captures. Reading everything takes one range of an archive for each block.
"""

import base64
import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Callable
from typing import NamedTuple
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import discard, materialize, open_fs, shuffle_width, slices
from quillspark.llm.urlfilter import LOWER, UPPER, lowered

ENTRIES, BLOCK_BYTES = 512, 8 << 20
LEVEL = 4
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_UNSAFE = re.compile("[\x00-\x20\x7f]")


class Record(NamedTuple):
    page_id: str | None
    url: str | None
    payload_bytes: int
    payload_digest: str
    record_type: str
    refers_to: str | None
    payload: bytes


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(page_id: str | None) -> str:
    """A record id; what is not a letter, a digit or one of `_.-~` is escaped, and a null id is apart from an empty one."""
    return "<urn:page>" if page_id is None else f"<urn:page:{quote(page_id, safe='')}>"


def id_of(name: str) -> str | None:
    return None if name == "<urn:page>" else unquote(name.removeprefix("<urn:page:").removesuffix(">"))


def record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None = None) -> bytes:
    """One gzip member: a response with its payload, or, with refers_to, a revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.0", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest_of(payload)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    block = http if refers_to is not None else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    zip_ = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return zip_.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + zip_.flush()


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])


def parse(member: bytes) -> Record:
    """The record of one gzip member; a response's payload must have the digest that its header gives."""
    data = zlib.decompress(member, 31)
    head, rest = data.split(b"\r\n\r\n", 1)
    h = _fields(head)
    block = rest[: int(h["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("the record has another length than its header says")
    http, payload = block.split(b"\r\n\r\n", 1)
    size, digest = int(_fields(http)["Content-Length"]), h["WARC-Payload-Digest"].removeprefix("sha1:")
    if h["WARC-Type"] == "response" and (len(payload) != size or digest_of(payload) != digest):
        raise ValueError(f"record {h['WARC-Record-ID']} fails its digest")
    refers = h.get("WARC-Refers-To")
    return Record(id_of(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), size, digest, h["WARC-Type"], refers and id_of(refers), payload)


def url_key(url: Column) -> Column:
    """Host labels in reverse order, then the rest of the URL without its scheme; empty for null."""
    rest = lowered(F.coalesce(F.regexp_replace(url, r"^[^/?#]*://", ""), F.lit("")))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.substr(rest, F.length(host) + F.lit(1)))


def key_of(url: str | None) -> str:
    """url_key of one URL."""
    rest = re.sub("[A-Z]+", lambda m: m[0].lower(), re.sub(r"^[^/?#]*://", "", url or ""))
    host = re.match(r"[^/?#]*", rest)[0]
    return ",".join(reversed(host.split("."))) + ")" + rest[len(host) :]


def write_archives(pages: DataFrame, out_dir: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, entries: int = ENTRIES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Write archives, index and sparse directories; returns a row for each block: part, block, first_key, last_key, archive, at, size, index, index_at, index_size, entries, sparse.

    Of records with equal payloads of at least `least` bytes (by SHA-1 and length), that with the largest id is the
    response and the others revisit it; smaller ones are responses. Null payloads are empty; null ids never get to be
    a response that others refer to; repeated rows with the largest id are each a response. Null URLs have an empty key; an
    empty table writes nothing; other columns are ignored. Only digests are grouped; pages travel once, to be dealt out
    and sorted by key, id and digest, so that only wholly repeated captures stay together. A repeated task writes files
    of its own, and the directory names those that count.
    """
    spark = pages.sparkSession
    payload, url = F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")), F.col(f"`{url_col}`").cast("string")
    full = pages.select(url_key(url).alias("key"), F.col(f"`{id_col}`").alias("id"), url.alias("url"), payload.alias("payload"), F.sha1(payload.cast("binary")).alias("sha"))
    digests = materialize(full.select("key", "id", "sha", F.octet_length("payload").alias("n")), "digests")
    own = digests.where(F.col("n") >= least)
    top = own.groupBy("sha", "n").agg(F.max("id").alias("top"), F.count(F.lit(1)).alias("c")).where("c > 1 AND top IS NOT NULL").select(F.col("sha").alias("s"), F.col("n").alias("m"), "top")
    revisits = own.join(top, (own["sha"] == top["s"]) & (own["n"] == top["m"])).where(~F.col("id").eqNullSafe(F.col("top")))
    # A marker of each revisit travels with the pages and is sorted before its page, so no page travels for a join.
    none = F.lit(None).cast("string")
    markers = revisits.select("key", "id", F.lit(0).alias("kind"), "sha", F.col("top").cast("string").alias("top"), none.alias("url"), none.alias("payload")).distinct()
    rows = markers.unionByName(full.select("key", "id", F.lit(1).alias("kind"), "sha", none.alias("top"), "url", "payload"))
    width = max(shuffle_width(spark), pages.rdd.getNumPartitions())
    ordered = rows.repartitionByRange(width, "key", "id", "sha").sortWithinPartitions("key", "id", "sha", "kind").select("key", F.col("id").cast("string").alias("id"), "url", "payload", "top", "kind", "sha")

    def write(batches):
        part, fs = TaskContext.get().partitionId(), None
        lines, first, at, index_at, block, held, out = [], None, 0, 0, 0, 0, []
        of, marked = None, {}  # the revisits of one key and id, by digest

        def flush():
            nonlocal lines, first, index_at, block, held
            body = zlib.compress("\n".join(lines).encode(), 6)
            index.write(body)
            out.append({"part": part, "block": block, "first_key": first[0], "last_key": last, "archive": archive_path, "at": first[1], "size": at - first[1], "index": index_path, "index_at": index_at, "index_size": len(body), "entries": len(lines), "sparse": sparse_path})
            index_at += len(body)
            block += 1
            lines, first, held = [], None, 0

        for batch in batches:
            if batch.num_rows and fs is None:
                fs, where = open_fs(out_dir)
                fs.create_dir(where, recursive=True)
                name = f"part-{part:06d}-{uuid.uuid4().hex[:12]}"
                archive_path, index_path, sparse_path = (f"{out_dir}/{name}{ext}" for ext in (".warc.gz", ".cdx.z", ".dir.z"))
                archive, index = (fs.open_output_stream(f"{where}/{name}{ext}", compression=None) for ext in (".warc.gz", ".cdx.z"))
            keys, ids, urls, tops, kinds, shas = (batch.column(i).to_pylist() for i in (0, 1, 2, 4, 5, 6))
            for start, payloads in slices(batch.column(3)):
                for i, text in enumerate(payloads, start):
                    if (keys[i], ids[i]) != of:
                        of, marked = (keys[i], ids[i]), {}
                    if not kinds[i]:
                        marked[shas[i]] = tops[i]
                        continue
                    member = record(ids[i], urls[i], text.encode(), marked.get(shas[i]))
                    archive.write(member)
                    first = first or (keys[i], at)
                    lines.append(json.dumps([at, len(member), ids[i], keys[i]]))
                    at += len(member)
                    held += len(text)
                    last = keys[i]
                    if len(lines) >= entries or held >= block_bytes:
                        flush()
        if fs is not None:
            if lines:
                flush()
            archive.close()
            index.close()
            with fs.open_output_stream(f"{where}/{name}.dir.z", compression=None) as sparse:
                sparse.write(zlib.compress(json.dumps([[r["first_key"], r["index_at"], r["index_size"]] for r in out]).encode(), 6))
            for i in range(0, len(out), 1000):
                yield pa.RecordBatch.from_pylist(out[i : i + 1000])

    schema = "part int, block int, first_key string, last_key string, archive string, at long, size long, index string, index_at long, index_size long, entries int, sparse string"
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    arrow = pa.schema([(n, types[t]) for n, t in (c.split() for c in schema.split(", "))])

    def typed(batches):
        for b in write(batches):
            yield pa.RecordBatch.from_pylist(b.to_pylist(), arrow)

    directory = materialize(ordered.mapInArrow(typed, schema), "directory")
    discard(digests)
    return directory


def read_range(uri: str, at: int, size: int) -> bytes:
    fs, where = open_fs(uri)
    with fs.open_input_file(where) as f:
        f.seek(at)
        return f.read(size)


def entries_of(body: bytes) -> list[tuple[int, int, str | None, str]]:
    """(offset, size, id, key) of each capture of an index block."""
    return [tuple(json.loads(line)) for line in zlib.decompress(body).decode().split("\n")]


class Part:
    """Lookups in one part: its sparse directory is held, one index block at a time is read."""

    def __init__(self, archive: str, index: str, sparse: str, read: Callable[[str, int, int], bytes] = None):
        self.archive, self.index, self.read = archive, index, read or read_range
        fs, where = open_fs(sparse)
        with fs.open_input_stream(where, compression=None) as f:
            self.blocks = json.loads(zlib.decompress(f.read()))
        self.firsts = [b[0] for b in self.blocks]
        self.held, self.entries, self.keys, self.blocks_read = -1, [], [], 0

    def captures(self, key: str):
        """The records of a key, in the order of the index; one capture is held at a time."""
        for n in range(max(0, bisect.bisect_left(self.firsts, key) - 1), bisect.bisect_right(self.firsts, key)):
            if n != self.held:
                self.entries, self.held = entries_of(self.read(self.index, *self.blocks[n][1:])), n
                self.keys = [e[3] for e in self.entries]
                self.blocks_read += 1
            for at, size, _, _ in self.entries[bisect.bisect_left(self.keys, key) : bisect.bisect_right(self.keys, key)]:
                yield parse(self.read(self.archive, at, size))


_RECORD = (("page_id", "string"), ("payload_bytes", "long"), ("payload_digest", "string"), ("record_type", "string"), ("refers_to", "string"), ("url", "string"), ("payload", "binary"))
_ARROW = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def _batches(records, payloads: bool, limit: int = BLOCK_BYTES):
    """Record batches of at most 4096 records and about limit bytes of payload."""
    fields = _RECORD if payloads else _RECORD[:5]
    schema = pa.schema([(n, _ARROW[t]) for n, t in fields])
    rows, held = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    for x in records:
        rows.append((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to, x.url, x.payload)[: len(fields)])
        held += len(x.payload) if payloads else 0
        if len(rows) >= 4096 or held >= limit:
            yield batch()
            rows, held = [], 0
    if rows:
        yield batch()


def _typed(got: DataFrame, kind: T.DataType) -> DataFrame:
    return got.withColumns({"page_id": F.col("page_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)})


def _schema(payloads: bool) -> str:
    return ", ".join(f"{n} {t}" for n, t in (_RECORD if payloads else _RECORD[:5]))


def lookup(directory: DataFrame, wanted: DataFrame, kind: T.DataType, url_col: str = "url", payloads: bool = False) -> DataFrame:
    """The records of every capture that has the key of a wanted URL, each once, with the columns of read_archives().

    A key goes to every part whose range of keys holds it; what the driver and the tasks hold of the parts is a row for
    each. Repeated wanted URLs count once; null ones find the captures without a URL. No archive is read but for what is found.
    """
    spark = directory.sparkSession
    parts = sorted(tuple(r) for r in directory.groupBy("part", "archive", "index", "sparse").agg(F.min("first_key").alias("a"), F.max("last_key").alias("z")).select("a", "z", "part", "archive", "index", "sparse").collect())
    held = spark.sparkContext.broadcast(parts)  # a row a part

    @F.arrow_udf("array<int>")
    def parts_of(keys: pa.Array) -> pa.Array:
        firsts, lasts = [p[0] for p in held.value], [p[1] for p in held.value]
        return pa.array([list(range(bisect.bisect_left(lasts, k), bisect.bisect_right(firsts, k))) for k in keys.to_pylist()], pa.list_(pa.int32()))

    def find(batches):
        def records():
            now, part = -1, None
            for batch in batches:
                for n, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if n != now:
                        now, part = n, Part(*held.value[n][3:])
                    yield from part.captures(key)

        yield from _batches(records(), payloads)

    keys = wanted.select(url_key(F.col(f"`{url_col}`").cast("string")).alias("key")).distinct()
    dealt = keys.select(F.explode(parts_of("key")).alias("n"), "key").repartition(max(shuffle_width(spark), len(parts)), "n").sortWithinPartitions("n", "key")
    return _typed(dealt.mapInArrow(find, _schema(payloads)), kind)


def read_archives(directory: DataFrame, kind: T.DataType, payloads: bool = False) -> DataFrame:
    """Every record of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to, and url and payload if asked for."""

    def read(batches):
        def records():
            for batch in batches:
                for r in batch.to_pylist():
                    data = memoryview(read_range(r["archive"], r["at"], r["size"]))  # one block, which is bounded in bytes
                    for at, size, _, _ in entries_of(read_range(r["index"], r["index_at"], r["index_size"])):
                        yield parse(data[at - r["at"] : at - r["at"] + size])

        yield from _batches(records(), payloads)

    width = shuffle_width(directory.sparkSession)
    return _typed(directory.repartition(width, "part", "block").mapInArrow(read, _schema(payloads)), kind)


def lookup_oracle(every: int = 20) -> str:
    """The captures that share a key with a page whose id is divisible by `every`, in SQL."""
    return f"""
    WITH r AS (SELECT page_id, coalesce(html, '') AS h, translate(regexp_replace(coalesce(url, ''), '^[^/?#]*://', ''), '{UPPER}', '{LOWER}') AS rest FROM pages),
    k AS (SELECT page_id, h, array_to_string(list_reverse(string_split(regexp_extract(rest, '^[^/?#]*'), '.')), ',') || ')' || regexp_replace(rest, '^[^/?#]*', '') AS key FROM r),
    a AS (SELECT page_id, key, strlen(h)::BIGINT AS payload_bytes, CASE WHEN page_id = max(page_id) OVER (PARTITION BY h) THEN 'response' ELSE 'revisit' END AS record_type,
                 CASE WHEN page_id <> max(page_id) OVER (PARTITION BY h) THEN max(page_id) OVER (PARTITION BY h) END AS refers_to FROM k)
    SELECT page_id, payload_bytes, record_type, refers_to FROM a WHERE key IN (SELECT key FROM k WHERE page_id % {every} = 0)"""


def oracle() -> str:
    """The query in SQL, with base32 of a digest written out: five bits of its hexadecimal digits at a time."""
    bits = "(('0x' || substr(sha, 5 * (i // 4)::INTEGER + 1, 5))::INTEGER >> (15 - 5 * (i % 4)::INTEGER)) & 31"
    return f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS sha FROM pages),
    m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
    SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
           array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ({bits}) + 1, 1) FOR i IN range(32)], '') AS payload_digest,
           CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
    FROM m"""
