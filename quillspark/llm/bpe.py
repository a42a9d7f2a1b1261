"""Byte-level BPE by corpus-level merge replay.

The distinct words of a run of texts are laid out as one chain of symbols. An inverted index holds, for the rank of each
pair of neighbours, the positions of that pair in all the words; the merges are applied in rank order over the whole
corpus at once, and a merge touches only the two neighbours of each of its positions. A pair whose merge has a lower
rank than the one being applied may appear beside it; the rest of that word then waits for the lower one, so that each
word gets the merges that it would get alone: lowest rank first, leftmost first.
"""

import base64
import functools
import heapq
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import slices

#: White space of the splitting pattern, but for the space and the line feed.
ODD_SPACE = re.compile("[\t\r\x0b\x0c\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

#: Ranks with fewer places than this are merged one by one, the others as arrays.
FEW = 32
#: Bytes of text whose words make one corpus.
RUN = 4_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class MergeReplay:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {r: t for t, r in ranks.items()}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.shift = max(1, max(self.token).bit_length())
        pairs = {}
        for whole, r in ranks.items():
            for i in range(1, len(whole)):
                a, b = ranks.get(whole[:i]), ranks.get(whole[i:])
                if a is not None and b is not None:
                    pairs[a << self.shift | b] = r
        #: Every pair that merges, sorted, with its rank; the last entry is for none.
        self.pairs = np.array([*sorted(pairs), 1 << 2 * self.shift], np.int64)
        self.merged = np.array([*(pairs[k] for k in sorted(pairs)), -1], np.int32)
        self.pair_rank = pairs
        #: Tokens whose merge can make a pair of lower rank.
        self.lowers = np.zeros(max(self.token) + 1, bool)
        left, right = self.pairs[:-1] >> self.shift, self.pairs[:-1] & (1 << self.shift) - 1
        self.lowers[left[self.merged[:-1] < left]] = True
        self.lowers[right[self.merged[:-1] < right]] = True

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a.astype(np.int64) << self.shift) | b
        at = np.searchsorted(self.pairs, keys)
        return np.where(self.pairs[at] == keys, self.merged[at], -1)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as unsigned 32-bit integers; a word that is a token as a whole is that token."""
        out = [np.array([r], "<u4").tobytes() if (r := self.ranks.get(w)) is not None else b"" for w in words]
        open_ = [i for i, ids in enumerate(out) if not ids and words[i]]
        if not open_:
            return out
        sizes = np.array([len(words[i]) for i in open_], np.int64)
        symbol = self.byte[np.frombuffer(b"".join([words[i] for i in open_]), np.uint8)]
        n = len(symbol)
        ends = np.cumsum(sizes)
        word = np.repeat(np.arange(len(open_), dtype=np.int32), sizes)
        follow, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        follow[ends - 1] = -1
        before[ends - sizes] = -1
        rank_at = np.full(n, -1, np.int32)  # of the pair that begins at a position; stale entries of the index differ from it
        inner = np.flatnonzero(follow >= 0)
        rank_at[inner] = self._ranks(symbol[inner], symbol[inner + 1])
        index: dict[int, list] = {}
        heap: list[int] = []

        def file(places: np.ndarray, ranks: np.ndarray) -> None:
            """Enter positions under the ranks of their pairs."""
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for r, part in zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(places, cuts), strict=True):
                if r not in index:
                    index[r] = []
                    heapq.heappush(heap, r)
                index[r].append(part)

        found = np.flatnonzero(rank_at >= 0)
        if len(found):
            file(found, rank_at[found])
        views = tuple(map(memoryview, (symbol, follow, before, rank_at, word)))
        while heap:
            rank = heapq.heappop(heap)
            parts = index.pop(rank)
            places = np.concatenate(parts) if len(parts) > 1 else parts[0]
            places = places[rank_at[places] == rank]
            if not len(places):
                continue
            if len(parts) > 1:
                places = np.unique(places)
            if len(places) < FEW:
                self._one_by_one(rank, places.tolist(), views, index, heap)
                continue
            near = np.zeros(len(places), bool)
            if self.lowers[rank]:  # words with several places go one by one: a lower merge may come between
                near[1:] = word[places[1:]] == word[places[:-1]]
                near[:-1] |= near[1:]
            else:
                near[1:] = follow[places[:-1]] == places[1:]
                if near.any():
                    near = np.isin(word[places], word[places[near]])
            if near.any():
                self._one_by_one(rank, places[near].tolist(), views, index, heap)
                places = places[~near]
            right = follow[places]
            beyond = follow[right]
            symbol[places] = rank
            symbol[right] = -1
            rank_at[right] = -1
            rank_at[places] = -1
            follow[places] = beyond
            on = beyond >= 0
            before[beyond[on]] = places[on]
            back = before[places]
            touched = np.concatenate([places[on], back[back >= 0]])
            if len(touched):
                new = self._ranks(symbol[touched], symbol[follow[touched]])
                rank_at[touched] = new
                some = new >= 0
                if some.any():
                    file(touched[some], new[some])
        alive = symbol >= 0
        ids = symbol[alive].astype("<u4").tobytes()
        upto = 4 * np.cumsum(np.bincount(word[alive], minlength=len(open_)))
        at = 0
        for i, to in zip(open_, upto.tolist(), strict=True):
            out[i] = ids[at:to]
            at = to
        return out

    def _one_by_one(self, rank: int, places: list[int], views: tuple, index: dict, heap: list) -> None:
        """Merge at the places in order, leftmost first; where a lower pair appears, the rest of that word waits for it."""
        symbol, follow, before, rank_at, word = views
        get, shift = self.pair_rank.get, self.shift
        waits, late = -1, []
        for p in places:
            if rank_at[p] != rank:
                continue
            if word[p] == waits:
                late.append(p)
                continue
            q = follow[p]
            n = follow[q]
            symbol[p] = rank
            symbol[q] = rank_at[q] = rank_at[p] = -1
            follow[p] = n
            if n >= 0:
                before[n] = p
            b = before[p]
            for at, left, right in ((p, rank, symbol[n] if n >= 0 else -1), (b, symbol[b] if b >= 0 else -1, rank)):
                if left < 0 or right < 0:
                    continue
                r = get(left << shift | right, -1)
                rank_at[at] = r
                if r >= 0:
                    if r not in index:
                        index[r] = []
                        heapq.heappush(heap, r)
                    index[r].append(np.array([at]))
                    if r < rank:
                        waits = word[p]
        if late:
            if rank not in index:
                index[rank] = []
                heapq.heappush(heap, rank)
            index[rank].append(np.array(late))


class Codec:
    """Ids of whole texts. Chunks between spaces split alike wherever they stand, so their ids are kept, up to a bound."""

    def __init__(self, path: str, pattern: str, held: int = 300_000):
        self.replay = MergeReplay(load_ranks(path))
        self.pattern = regex.compile(pattern)
        self.held = held
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}  # with a space before them
        tokens = [self.replay.token.get(i, b"") for i in range(max(self.replay.token) + 1)]
        #: The bytes of all tokens after one another, and where each token's begin.
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.starts = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])

    def _learn_words(self, need: set) -> None:
        missing = need.difference(self.words)
        if len(self.words) + len(missing) > self.held:
            self.words = {w: self.words[w] for w in need.difference(missing)}
        fresh = list(missing)
        for w, ids in zip(fresh, self.replay.encode([w.encode() for w in fresh]), strict=True):
            self.words[w] = ids

    @staticmethod
    def plain(text: str) -> bool:
        """Whether every white space is one space or line feed between other characters, or stands at an end."""
        if "  " in text or "\n\n" in text or "\n " in text or " \n" in text:
            return False
        return not ODD_SPACE.search(text)

    def encode(self, texts: list) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text (null: none)."""
        cut, need_chunks, need_words = [], set(), set()
        for text in texts:
            if text and self.plain(text):
                lines = [line.split(" ") for line in text.split("\n")]
                for line in lines:
                    need_words.add(line[0])
                    need_chunks.update(line[1:])
                cut.append(lines)
            else:
                words = self.pattern.findall(text) if text else []
                need_words.update(words)
                cut.append(tuple(words))
        # The first chunk of a line has no space before it and may hold several words.
        missing = need_chunks.difference(self.chunks)
        if len(self.chunks) + len(missing) > self.held:
            self.chunks = {c: self.chunks[c] for c in need_chunks.difference(missing)}
        find = self.pattern.findall
        parts = {c: find(" " + c) for c in missing}
        heads = {h: find(h) for h in need_words}
        need = {"\n"}.union(*parts.values(), *heads.values())
        self._learn_words(need)
        word = self.words.__getitem__
        for c, ws in parts.items():
            self.chunks[c] = b"".join(map(word, ws))
        head = {h: b"".join(map(word, ws)) for h, ws in heads.items()}.__getitem__
        chunk, feed = self.chunks.__getitem__, self.words["\n"]
        return [feed.join([head(line[0]) + b"".join(map(chunk, line[1:])) for line in c]) if type(c) is list else b"".join(map(word, c)) for c in cut]

    def decode(self, ids: bytes) -> bytes:
        """The bytes of little-endian unsigned 32-bit ids: one gather from the bytes of all tokens; an unknown id within the vocabulary's range has none."""
        at = np.frombuffer(ids, "<u4")
        first, sizes = self.starts[at], self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(sizes)
        return self.token_bytes[np.repeat(first - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def round_trip(text: Column, ranks: str, pattern: str) -> Column:
    """struct(ids, decoded): the ids of a text as little-endian unsigned 32-bit integers, and the bytes that they stand for.

    Null and empty texts have no ids. No string in a text is special.
    """

    @F.arrow_udf("struct<ids:binary,decoded:binary>")
    def both(column: pa.Array) -> pa.Array:
        c = codec(ranks, pattern)
        ids, plain = [], []
        for _, texts in slices(column, RUN):
            got = c.encode(texts)
            ids += got
            plain += map(c.decode, got)
        return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(plain, pa.binary())], ["ids", "decoded"])

    return both(text.cast("string"))


def encode(docs: DataFrame, ranks: str, pattern: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """Adds the ids of every text as array<int>, in place of a column of that name."""

    @F.arrow_udf("array<int>")
    def ids_of(column: pa.Array) -> pa.Array:
        c = codec(ranks, pattern)
        got = [np.frombuffer(b, "<i4") for _, texts in slices(column, RUN) for b in c.encode(texts)]
        return pa.array(got, pa.list_(pa.int32()))

    return docs.withColumn(out, ids_of(F.col(text_col).cast("string")))


def decode(tokens: DataFrame, ranks: str, pattern: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the bytes that array<int> ids stand for (null: none)."""

    @F.arrow_udf("binary")
    def bytes_of(column: pa.Array) -> pa.Array:
        c = codec(ranks, pattern)
        return pa.array([c.decode(np.array(ids or (), "<u4").tobytes()) for ids in column.to_pylist()], pa.binary())

    return tokens.withColumn(out, bytes_of(F.col(ids_col)))


def digests(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document; no shuffle.

    Null and empty texts have no tokens and the digests of nothing; repeated rows and null ids are kept each; an empty
    table gives no rows; other columns are ignored.
    """
    both = docs.select(F.col(f"`{id_col}`").alias("_id"), round_trip(F.col(f"`{text_col}`"), ranks, pattern).alias("_b"))
    return both.select(F.col("_id").alias(id_col), (F.octet_length("_b.ids") / 4).cast("long").alias("n_tokens"), F.sha2("_b.ids", 256).alias("ids_sha256"), F.sha2("_b.decoded", 256).alias("decoded_sha256"))
