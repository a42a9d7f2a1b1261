"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy, by backpropagation through time, on passages of a bounded sample of labelled documents.
It reads a text in stretches of STRETCH bytes, never cut within a code point, each together with HALO bytes of context on
both sides and from both ends; it labels every byte of the stretch with language probabilities, and a document's
probabilities are the mean over its bytes. Gates are the piecewise linear forms of the
sigmoid and the hyperbolic tangent, which numpy computes several times as fast.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import row_of, slices

STRETCH, HALO, HIDDEN = 64, 16, 8
#: Bytes that are read at once: a stretch and its context, each border moved by up to three bytes to where a code point begins.
WIDTH = STRETCH + 2 * HALO + 6
#: Bounds of the training sample: languages (those with the most documents), documents of each, and characters of the passage taken from each.
LANGS, PER_LANG, PASSAGE = 200, 300, 640
STEPS, BATCH, RATE, SEED = 200, 128, 0.02, 7
#: Stretches that are read side by side.
SIDE = 4096
UNKNOWN = "und"
#: Mean probability below which no language is taken as known; a text half in another language stays above it.
LEAST = 0.4


class Network:
    """x[2, 256, 3h], u[2, h, 3h]: input and recurrent weights of both directions; v[2, h, k], c[k]: to language scores."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        k = len(langs)
        self.langs, self.hidden = langs, hidden
        self.p = {
            "x": rng.normal(0, 0.3, (2, 256, 3 * hidden)),
            "u": rng.normal(0, 0.4 / np.sqrt(hidden), (2, hidden, 3 * hidden)),
            "v": rng.normal(0, 0.3, (2, hidden, k)),
            "c": np.zeros(k),
        }
        self.p = {n: w.astype(np.float32) for n, w in self.p.items()}

    def gradients(self, x: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[float, dict]:
        """Loss and gradients for x[batch, time] bytes, mask of real positions and the language of each row."""
        h_n, (b, steps) = self.hidden, x.shape
        both = np.stack([x, x[:, ::-1]])  # direction, batch, time
        wx, u = self.p["x"], self.p["u"]
        inputs = np.stack([wx[0][both[0]], wx[1][both[1]]])
        h = np.zeros((2, b, h_n), np.float32)
        saved, states = [], np.empty((steps, 2, b, h_n), np.float32)
        for t in range(steps):
            m = h @ u
            a = inputs[:, :, t]
            gate = np.clip(0.2 * (a[..., : 2 * h_n] + m[..., : 2 * h_n]) + 0.5, 0, 1)
            z, r = gate[..., :h_n], gate[..., h_n:]
            pre = a[..., 2 * h_n :] + r * m[..., 2 * h_n :]
            n = np.clip(pre, -1, 1)
            saved.append((h, m, gate, pre, n))
            h = n + z * (h - n)
            states[t] = h
        ahead, back = states[:, 0], states[::-1, 1]  # by position: time, batch, hidden
        score = ahead @ self.p["v"][0] + back @ self.p["v"][1] + self.p["c"]
        score -= score.max(-1, keepdims=True)
        prob = np.exp(score)
        prob /= prob.sum(-1, keepdims=True)
        real = mask.T[..., None].astype(np.float32) / max(1, mask.sum())
        own = np.take_along_axis(prob, np.broadcast_to(label[None, :, None], (steps, b, 1)), -1)
        loss = float(-(np.log(own + 1e-9) * real).sum())
        d = prob * real
        np.put_along_axis(d, np.broadcast_to(label[None, :, None], (steps, b, 1)), np.take_along_axis(d, np.broadcast_to(label[None, :, None], (steps, b, 1)), -1) - real, -1)
        flat = d.reshape(-1, d.shape[-1])
        g = {"c": flat.sum(0), "v": np.stack([ahead.reshape(-1, h_n).T @ flat, back.reshape(-1, h_n).T @ flat])}
        into = np.stack([d @ self.p["v"][0].T, (d @ self.p["v"][1].T)[::-1]], 1)  # time, direction, batch, hidden
        du, da = np.zeros_like(u), np.empty((2, b, steps, 3 * h_n), np.float32)
        dh = np.zeros((2, b, h_n), np.float32)
        ut = u.transpose(0, 2, 1)
        for t in range(steps - 1, -1, -1):
            h, m, gate, pre, n = saved[t]
            z, r = gate[..., :h_n], gate[..., h_n:]
            dh = dh + into[t]
            dpre = dh * (1 - z) * (np.abs(pre) < 1)
            dgate = np.concatenate([dh * (h - n), dpre * m[..., 2 * h_n :]], -1) * 0.2 * ((gate > 0) & (gate < 1))
            dm = np.concatenate([dgate, dpre * r], -1)
            da[:, :, t] = np.concatenate([dgate, dpre], -1)
            du += h.transpose(0, 2, 1) @ dm
            dh = dh * z + dm @ ut
        g["u"] = du
        g["x"] = np.stack([np.stack([np.bincount(both[d_].ravel(), da[d_, :, :, j].ravel(), 256) for j in range(3 * h_n)], 1) for d_ in range(2)])
        return loss, g

    def train(self, x: np.ndarray, mask: np.ndarray, label: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> list[float]:
        """Adam over batches that hold every language alike."""
        rng = np.random.default_rng(seed)
        rows = [np.flatnonzero(label == k) for k in range(len(self.langs))]
        first, second = ({n: np.zeros_like(w) for n, w in self.p.items()} for _ in range(2))
        losses = []
        for step in range(1, steps + 1):
            take = np.concatenate([rng.choice(r, -(-batch // len(rows))) for r in rows])
            loss, g = self.gradients(x[take], mask[take], label[take])
            losses.append(loss)
            now = rate * min(1, 2 * (1 - step / (steps + 1)))
            for n in self.p:
                first[n] = 0.9 * first[n] + 0.1 * g[n]
                second[n] = 0.99 * second[n] + 0.01 * g[n] ** 2
                self.p[n] = (self.p[n] - now * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return losses

    def _read(self, x: np.ndarray, d: int) -> np.ndarray:
        """States of one direction, by position: time, rows, hidden. x is time-major bytes."""
        h_n = self.hidden
        scale = np.repeat(np.array([0.2, 0.2, 1], np.float32), h_n)
        shift = np.repeat(np.array([0.5, 0.5, 0], np.float32), h_n)
        wx, u = self.p["x"][d] * scale + shift, self.p["u"][d] * scale
        gates = [(np.ascontiguousarray(wx[:, s]), np.ascontiguousarray(u[:, s])) for s in (slice(0, h_n), slice(h_n, 2 * h_n), slice(2 * h_n, 3 * h_n))]
        steps, b = x.shape
        out = np.empty((steps, b, h_n), np.float32)
        h = np.zeros((b, h_n), np.float32)
        z, r, n, a = (np.empty((b, h_n), np.float32) for _ in range(4))
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            for g, (w, v) in zip((z, r), gates, strict=False):
                np.matmul(h, v, out=g)
                np.take(w, x[t], axis=0, out=a, mode="clip")
                g += a
                np.maximum(g, 0, out=g)
                np.minimum(g, 1, out=g)
            w, v = gates[2]
            np.matmul(h, v, out=n)
            n *= r
            np.take(w, x[t], axis=0, out=a, mode="clip")
            n += a
            np.maximum(n, -1, out=n)
            np.minimum(n, 1, out=n)
            np.subtract(h, n, out=a)
            a *= z
            h = np.add(n, a, out=out[t])
        return out

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities [language, time, rows] of every byte of time-major stretches."""
        steps, b = x.shape
        ahead, back = self._read(x, 0).reshape(-1, self.hidden), self._read(x, 1).reshape(-1, self.hidden)
        score = self.p["v"][0].T @ ahead.T
        score += self.p["v"][1].T @ back.T
        score += self.p["c"][:, None]
        np.clip(score, -40, 40, out=score)
        np.exp(score, out=score)
        score /= score.sum(0)
        return score.reshape(-1, steps, b)

    def pooled(self, texts: list[bytes], side: int = SIDE) -> np.ndarray:
        """Mean probabilities [text, language] over all bytes of each text; zeros for an empty one."""
        sizes = np.array([len(t) for t in texts], np.int64)
        cut = Windows(texts)
        out = np.zeros((len(texts), len(self.langs)))
        for at in range(0, len(cut), side):
            x, mask, of = cut.rows(slice(at, at + side))
            prob = self.positions(np.ascontiguousarray(x.T))
            prob *= mask.T
            each = prob.sum(1)
            for j in range(len(self.langs)):
                out[:, j] += np.bincount(of, each[j], len(texts))
        return out / np.maximum(sizes, 1)[:, None]


class Windows:
    """The stretches of texts in UTF-8, with their context."""

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.data = np.frombuffer(b"".join(texts) + b"\0\0\0\0", np.uint8)
        self.inside = (self.data & 0xC0) == 0x80
        begins = np.concatenate([[0], np.cumsum(sizes)])
        pieces = -(-sizes // STRETCH)
        of = np.repeat(np.arange(len(texts)), pieces)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        low, high = begins[of], begins[of + 1]
        start = np.minimum(self.snapped(low + nth * STRETCH), high)
        end = np.minimum(self.snapped(np.minimum(low + (nth + 1) * STRETCH, high)), high)
        some = start < end
        self.of, self.start, self.end = of[some], start[some], end[some]
        self.first = self.snapped(np.maximum(self.start - HALO, low[some]))
        self.last = np.minimum(self.snapped(np.minimum(self.end + HALO, high[some])), high[some])

    def __len__(self) -> int:
        return len(self.of)

    def snapped(self, at: np.ndarray) -> np.ndarray:
        """Where the code point at or after each place begins."""
        for _ in range(3):
            at = at + self.inside[at]
        return at

    def rows(self, part: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes [window, WIDTH] with zeros at the end, mask of the stretch itself, and the text of each window."""
        at = self.first[part, None] + np.arange(WIDTH)
        x = np.where(at < self.last[part, None], self.data[np.minimum(at, len(self.data) - 1)], 0)
        return x, (at >= self.start[part, None]) & (at < self.end[part, None]), self.of[part]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def stretches(passages: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes [window, WIDTH], mask of the stretches themselves, and the passage of each."""
    return Windows([t.encode() for t in passages]).rows(slice(None))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_passages(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int = PER_LANG, passage: int = PASSAGE, most: int = LANGS) -> list[tuple[str, str]]:
    """(language, passage) of at most per_lang distinct labelled documents of each language, drawn by hash; null ids are never drawn.

    The rate of a language follows its usable documents: those whose passage has a letter, repeated rows counted once.
    Where there are more than `most` languages, those with the most usable documents are learned.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).alias("lang"))
    start = F.lit(1) + F.pmod(F.shiftright("h", 20), F.greatest(F.lit(1), F.length("t") - passage + 1)).cast("int")
    hashed = rows.withColumn("h", F.xxhash64(F.lit(SEED), "i", "t")).select("lang", "h", F.substring("t", start, F.lit(passage)).alias("p"))
    usable = hashed.where(F.regexp_like("p", F.lit(r"\p{L}")))
    known = usable.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).orderBy(F.desc("n"), "lang").limit(most).collect()
    if not known:
        return []
    rates = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, 3 * per_lang / r["n"])) for r in known], "lang string, rate double")
    drawn = usable.join(F.broadcast(rates), "lang").where(F.pmod("h", F.lit(1_000_003)) < F.col("rate") * 1_000_003)  # at most `most` rows are sent
    drawn = drawn.groupBy("lang", "h").agg(F.min("p").alias("p")).collect()  # repeated rows count once
    found: dict[str, list] = {}
    for r in sorted(drawn, key=lambda r: (r["lang"], r["h"])):
        if has_letter(r["p"]) and len(found.setdefault(r["lang"], [])) < per_lang:
            found[r["lang"]].append(r["p"])
    return [(lang, p) for lang, ps in found.items() for p in ps]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **bounds) -> Network | None:
    """A network trained on documents that are not held out; None where there is no labelled text."""
    drawn = training_passages(docs, id_col, text_col, lang_col, **bounds)
    if not drawn:
        return None
    langs = sorted({lang for lang, _ in drawn})
    x, mask, of = stretches([p for _, p in drawn])
    net = Network(langs)
    net.train(x, mask, np.array([langs.index(lang) for lang, _ in drawn])[of])
    return net


def predict(net: Network | None, text: Column) -> Column:
    """struct(lang, score): the likeliest language and its mean probability; `und` and 0 for null, for no letter, or without a network."""

    @F.arrow_udf("struct<lang:string,score:double>")
    def label(column: pa.Array) -> pa.Array:
        langs, scores = [], []
        for _, texts in slices(column):
            known = [bool(net and t and has_letter(t)) for t in texts]
            if not any(known):
                langs += [UNKNOWN] * len(texts)
                scores += [0.0] * len(texts)
                continue
            prob = net.pooled([t.encode() if k else b"" for t, k in zip(texts, known, strict=True)])
            best = prob.argmax(1)
            langs += [net.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
            scores += [min(1.0, float(p[b])) if k else 0.0 for p, b, k in zip(prob, best, known, strict=True)]
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return label.asNondeterministic()(text.cast("string"))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", net: Network | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; trains on docs unless a network is given. No shuffle of texts.

    Null and empty texts and those without a letter are `und` with score 0, and so is everything where no text is
    labelled; repeated rows are labelled each; null ids are never held out nor learned from; ties go to the language that
    comes first; an empty table gives no rows; other columns are ignored.
    """
    net = net or fit(docs, id_col, text_col, lang_col)
    got = docs.select(F.col(f"`{id_col}`").alias("doc_id"), held_out(id_col).alias("held_out"), predict(net, F.col(f"`{text_col}`")).alias("_l"))
    return got.select("doc_id", "held_out", F.col("_l.lang").alias("lang_pred"), "_l.score")


def keep_known(docs: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents whose language is known with a probability of at least `least`, with their columns, whatever these are called.

    Null and empty texts and those without a letter go; without labelled text all with a letter stay; repeated rows are
    judged each; an empty table stays empty.
    """
    net = fit(docs, id_col, text_col, lang_col)
    held = docs.select(row_of(docs).alias("row"), predict(net, F.col(text_col)).alias("l"))
    if net is None:
        return docs.where(F.coalesce(F.regexp_like(F.col(text_col), F.lit(r"\p{L}")), F.lit(False)))
    return held.where((F.col("l.lang") != UNKNOWN) & (F.col("l.score") >= least)).select("row.*")
