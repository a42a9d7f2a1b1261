"""Document fingerprints by SpotSigs.

Each occurrence of an anchor (a common word, or a word of one or two characters) starts a chain of the next content
words; anchor and chain are a spot signature. A document's fingerprint is the whole set of them, written as text: eight
characters for each of the sorted signatures, which are the first 48 bits of an MD5, so that a likeness can be computed
from two fingerprints alone and any engine can make them.
Sets are compared by Jaccard likeness, many pairs at a time: pairs are dealt out by length partition, which grow by
1 / NEAR, so that a pair more than one partition apart cannot be near; of the others, those that share none of the
smaller set's first signatures are pruned; and the survivors are counted out. Where the value of a pruned pair is asked
for as well, as in the registered query, it is counted too.
"""

import base64
import bisect
import hashlib
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import shuffle_width, slices
from quillspark.llm.urlfilter import LOWER, UPPER

#: Common words of English, German, French and Spanish.
ANCHORS = """
the of and to in is that it for was on are as with by at be this from or an
der die das und ist nicht ein eine den von mit zu im auf für als auch sich des dem
le la les des et est un une que qui dans pour par sur pas du au en
el los las de y que en un una por con para se del al es lo como
"""
_ANCHORS = {w.encode() for w in ANCHORS.split()}
_DROPPED = "".join(c for c in string.punctuation if c != "|").encode()
CHAIN = 2
NEAR = 0.8
#: Bits of a signature; eight characters of base64 hold them, and 16 bits are left to tell pairs apart.
BITS = 48
#: Sample rows for each range of ids.
SAMPLED = 60


def spots(text: str, chain: int = CHAIN) -> np.ndarray:
    """The spot signatures of a text, sorted; a text without any is one signature of its own."""
    data = text.encode()
    content: list[bytes] = []
    marks: list[tuple[bytes, int]] = []
    for w in data.lower().translate(None, _DROPPED).split():
        if len(w) <= 2 or w in _ANCHORS:
            marks.append((w, len(content)))
        else:
            content.append(w)
    last, md5 = len(content) - chain, hashlib.md5
    chains = {b" ".join((w, *content[k : k + chain])) for w, k in marks if k <= last} or {b"whole " + data}
    digests = b"".join([md5(c, usedforsecurity=False).digest() for c in chains])
    return np.unique(np.frombuffer(digests, ">u8")[::2].astype(np.uint64) >> np.uint64(64 - BITS))


def fingerprint_of(found: np.ndarray) -> str:
    """Sorted signatures as text, eight characters each."""
    return base64.b64encode(found.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def spots_of(fingerprint: str) -> np.ndarray:
    """The signatures that a fingerprint holds."""
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, 6)
    return np.concatenate([np.zeros((len(raw), 2), np.uint8), raw], 1).view(">u8").ravel().astype(np.uint64)


def partition_of(size: np.ndarray, least: float = NEAR) -> np.ndarray:
    """Length partitions: sets alike by `least` or more are in the same one or in neighbours."""
    return np.floor(np.log(size) / np.log(1 / least) + 1e-9).astype(np.int64)


def _shared(few: list[np.ndarray], many: list[np.ndarray]) -> np.ndarray:
    """How many elements of each sorted array are in the one at the same place of the other list."""
    out = np.zeros(len(few), np.int64)
    for at in range(0, len(few), 1 << 64 - BITS):
        x, y = few[at : at + (1 << 64 - BITS)], many[at : at + (1 << 64 - BITS)]
        tag = lambda sets: np.concatenate(sets) | np.repeat(np.arange(len(sets), dtype=np.uint64), [len(s) for s in sets]) << np.uint64(BITS)
        a, b = tag(x), tag(y)
        place = np.minimum(np.searchsorted(b, a), len(b) - 1)
        out[at : at + len(x)] = np.bincount((a[b[place] == a] >> np.uint64(BITS)).astype(np.int64), minlength=len(x))
    return out


def likenesses(pairs: list[tuple[np.ndarray, np.ndarray]], least: float = NEAR, every: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(Jaccard likeness, whether it is at least `least`) of each pair of sorted sets; without `every`, 0 for pairs that are not."""
    value, near = np.zeros(len(pairs)), np.zeros(len(pairs), bool)
    if not pairs:
        return value, near
    both = [(a, b) if len(a) <= len(b) else (b, a) for a, b in pairs]
    n, m = (np.array([len(p[i]) for p in both]) for i in (0, 1))
    need = np.ceil(least / (1 + least) * (n + m) - 1e-9).astype(np.int64)  # elements that near sets share
    step = partition_of(m, least) - partition_of(n, least)
    left = np.flatnonzero((step <= 1) & (need <= n))
    # Near sets share one of the smaller one's first n - need + 1 signatures.
    some = _shared([both[i][0][: n[i] - need[i] + 1] for i in left], [both[i][1] for i in left]) if len(left) else left
    left = left[some > 0]
    for places in (left, np.setdiff1d(np.arange(len(pairs)), left) if every else left[:0]):
        if len(places):
            shared = _shared([both[i][0] for i in places], [both[i][1] for i in places])
            value[places] = shared / (n[places] + m[places] - shared)
            if places is left:
                near[places] = shared >= need[places]
                value[places] = np.where(near[places] | every, value[places], 0)
    return value, near


def edited(text: str, other: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


COLUMNS = (("n_chars", "long"), ("edited_sha256", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double"), ("n_spots", "long"))
_TYPES = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}


def _ranges(keyed: DataFrame, width: int) -> tuple[Column, list[tuple]]:
    """For keyed(k, h): the number of a row's range, and (range, next smaller row's key) for each range, around at the end.

    The borders are quantiles of a sample of SAMPLED rows a range, drawn by hash, so that every job that asks for the
    number of a row gets the same one.
    """
    spark, n = keyed.sparkSession, keyed.count()
    drawn = keyed.where(F.pmod(F.xxhash64("k", "h", F.lit(1)), F.lit(max(1, n // (SAMPLED * width)))) == 0).collect() if n else []  # SAMPLED a range
    order = lambda k, h: (k is not None, k, h)
    ranked = sorted(order(*r) for r in drawn)
    borders = spark.sparkContext.broadcast(sorted({ranked[i * len(ranked) // width] for i in range(1, width)}) if ranked else [])

    @F.arrow_udf("int")
    def number(k: pa.Array, h: pa.Array) -> pa.Array:
        return pa.array([bisect.bisect_right(borders.value, order(a, b)) for a, b in zip(k.to_pylist(), h.to_pylist(), strict=True)], pa.int32())

    part = number("k", "h")
    most = keyed.select(part.alias("part"), F.struct("k", "h").alias("key")).groupBy("part").agg(F.max("key").alias("key"))
    tails = sorted((r["part"], r["key"]["k"], r["key"]["h"]) for r in most.collect())  # one a range
    return part, [(tails[i][0], *tails[i - 1][1:]) for i in range(len(tails))]


def chained(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and COLUMNS: each document against its edited text and against the next one, by descending id (after the last: the first).

    Texts are dealt out once, by ranges of ids and, within an id, of hashes of the text. Each range begins with a copy of
    the document that its first one is compared with, so a task streams through its rows and keeps one. Null texts are
    empty; repeated ids follow one another by hash of their text, largest first, and rows that repeat both stay
    together; null ids come last; a single document is its own next; an empty table gives no rows; other columns are ignored.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("k"), F.xxhash64(text).alias("h"), text.alias("t"))
    width = max(shuffle_width(spark), docs.rdd.getNumPartitions())
    part, before = _ranges(rows.select("k", "h"), width)
    heads = spark.createDataFrame(before, T.StructType([T.StructField("part", T.IntegerType()), T.StructField("_k", kind), T.StructField("_h", T.LongType())]))
    met = rows.join(F.broadcast(heads), F.col("k").eqNullSafe(F.col("_k")) & (F.col("h") == F.col("_h"))).groupBy("part").agg(F.first("t").alias("t"))  # a row a range
    own = rows.select(part.alias("part"), F.lit(True).alias("own"), "k", "h", "t")
    dealt = own.unionByName(met.select("part", F.lit(False).alias("own"), F.lit(None).cast(kind).alias("k"), F.lit(0).cast("long").alias("h"), "t"))
    dealt = dealt.repartitionById(width, "part").sortWithinPartitions("part", "own", "k", "h")
    schema = T.StructType([T.StructField("doc_id", kind), *T._parse_datatype_string(",".join(f"{n} {t}" for n, t in COLUMNS)).fields])

    def compare(batches):
        last = None
        for batch in batches:
            keys = batch.column(1)
            for first, texts in slices(batch.column(2)):
                at, done, pairs = [], [], []
                for i, (text, mine) in enumerate(zip(texts, batch.column(0).slice(first, len(texts)).to_pylist(), strict=True), first):
                    found = spots(text)
                    if mine:
                        other, others = last
                        mixed = edited(text, other)
                        of_mixed = spots(mixed)
                        at.append(i)
                        done.append((len(text), hashlib.sha256(mixed.encode()).hexdigest(), fingerprint_of(found), fingerprint_of(of_mixed), len(found)))
                        pairs += [(found, of_mixed), (found, others)]
                    last = (text, found)
                if at:
                    value, _ = likenesses(pairs, every=True)
                    chars, sha, own_print, mixed_print, size = zip(*done, strict=True)
                    columns = [chars, sha, own_print, mixed_print, value[::2], value[1::2], size]
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(at)), *[pa.array(c, _TYPES[t]) for c, (_, t) in zip(columns, COLUMNS, strict=True)]], schema.names)

    return dealt.select("own", "k", "t").mapInArrow(compare, schema)


def oracle() -> str:
    """The query in SQL, with every set written out and no pair pruned."""
    low = f"regexp_replace(translate(s, '{UPPER}', '{LOWER}'), '[!-/:-@\\[-`{{}}~]', '', 'g')"
    anchors = ", ".join(f"'{w}'" for w in sorted(set(ANCHORS.split())))
    following = " AND ".join(f"c{i}.id = m.id AND c{i}.side = m.side AND c{i}.nth = m.nth + {i}" for i in range(1, CHAIN + 1))
    chained = " || ".join(["m.w", *[f"' ' || c{i}.w" for i in range(1, CHAIN + 1)]])
    likeness = lambda a, b: f"len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b})))"
    written = lambda s: f"to_base64(unhex(array_to_string({s}, '')))"
    return f"""
    WITH d AS (SELECT doc_id AS id, coalesce(text, '') AS t FROM documents),
    n AS (SELECT id, t, coalesce(lead(t) OVER (ORDER BY id DESC), first_value(t) OVER (ORDER BY id DESC)) AS o FROM d),
    e AS (SELECT id, t, substr(t, 1, length(t) - length(t) // 2) || substr(o, 1, length(t) // 2) AS m FROM n),
    sides AS (SELECT id, 'own' AS side, t AS s FROM e UNION ALL SELECT id, 'edited', m FROM e),
    ws AS (SELECT id, side, regexp_extract_all({low}, '[^\\x20\\x09-\\x0D]+') AS ws FROM sides),
    word AS (SELECT id, side, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM ws),
    told AS (SELECT *, strlen(w) <= 2 OR w IN ({anchors}) AS mark FROM word),
    placed AS (SELECT *, sum(CASE WHEN mark THEN 0 ELSE 1 END) OVER (PARTITION BY id, side ORDER BY i) AS nth FROM told),
    content AS (SELECT id, side, w, nth FROM placed WHERE NOT mark),
    spot AS (SELECT DISTINCT m.id, m.side, substr(md5({chained}), 1, {BITS // 4}) AS h
             FROM placed AS m, {", ".join(f"content AS c{i}" for i in range(1, CHAIN + 1))} WHERE m.mark AND {following}),
    held AS (SELECT id, side, list_sort(list(h)) AS hs FROM spot GROUP BY id, side),
    f AS (SELECT b.id, b.side, coalesce(hs, [substr(md5('whole ' || s), 1, {BITS // 4})]) AS hs FROM sides AS b LEFT JOIN held USING (id, side)),
    a AS (SELECT e.id, t, m, x.hs AS own, y.hs AS edited FROM e JOIN f AS x ON x.id = e.id AND x.side = 'own' JOIN f AS y ON y.id = e.id AND y.side = 'edited'),
    z AS (SELECT *, coalesce(lead(own) OVER (ORDER BY id DESC), first_value(own) OVER (ORDER BY id DESC)) AS next FROM a)
    SELECT id AS doc_id, length(t)::BIGINT AS n_chars, sha256(m) AS edited_sha256, {written("own")} AS fingerprint, {written("edited")} AS edited_fingerprint,
           {likeness("own", "edited")} AS near_edited, {likeness("own", "next")} AS near_next, len(own)::BIGINT AS n_spots
    FROM z"""
