"""Quality by weak supervision: rules vote good or bad or abstain, expectation-maximisation weighs them.

Each rule has, for good and for bad documents, its own chance of voting bad where it votes at all. These are estimated
without labels from the counts of vote patterns (at most 3 to the number of rules, whatever the corpus) of the documents
that pass the base test, and the posterior probability of being good replaces a filter that all rules must pass. An
abstention is no evidence: it moves neither a posterior nor what is learned of a rule.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import materialize, row_of, slices

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (*BASE, "n_lines", "n_upper", "n_lower", "n_marks", "n_runs")
WINDOW = 8
LATIN = "2 * (n_upper + n_lower) > word_chars"
#: Name, when it votes bad, when it votes good; else it abstains. In integers, so that every engine agrees.
RULES = (
    ("symbols", "10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    ("lines", "n_lines >= 2 AND 2 * n_dup_lines > n_lines", "n_lines >= 2 AND n_dup_lines = 0"),
    # Of Latin text alone: other scripts have words of other lengths, or none between spaces.
    ("word_length", f"{LATIN} AND (word_chars < 2 * n_words OR word_chars > 12 * n_words)", f"{LATIN} AND word_chars >= 3 * n_words AND word_chars <= 10 * n_words"),
    ("capitals", "n_upper > n_lower", "n_lower > 0 AND 4 * n_upper <= n_lower"),
    ("marks", "5 * n_marks > n_words", "20 * n_marks <= n_words"),
    ("runs", "10 * n_runs > n_words", "50 * n_runs <= n_words"),
)
BASE_FAILED = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"
ROUNDS = 40
#: Share of a rule's bad votes that fall on good documents, at most; and of a rule's votes on bad documents that are good, at least, as
#: one defect is enough. Without them the likeliest two classes may be one kind of junk and everything else.
WRONG, FINE, SMOOTH = 0.1, 0.5, 0.1
THRESHOLD = 0.5

SPACE, SYMBOL, UPPER, LOWER, MARK, REST, INSIDE = range(7)


def _classes() -> np.ndarray:
    """Class of each byte; INSIDE are those that continue a code point."""
    of = np.full(256, REST, np.uint8)
    of[0x80:0xC0] = INSIDE
    of[[0x20, *range(0x09, 0x0E)]] = SPACE
    of[list(b"#*$%&|<>")] = SYMBOL
    of[ord("A") : ord("Z") + 1] = UPPER
    of[ord("a") : ord("z") + 1] = LOWER
    of[list(b"!?")] = MARK
    return of


CLASSES = _classes()


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window of words found twice or more; windows are named exactly, by doubling."""
    n = len(ids)
    if n <= window:
        return 0
    name, held = ids.astype(np.int64), 1
    while held < window:
        step = min(held, window - held)
        pair = name[: len(name) - step] * (int(name.max()) + 1) + name[step:]
        name = np.unique(pair, return_inverse=True)[1]
        held += step
    again = np.flatnonzero(np.bincount(name)[name] > 1)
    if not len(again):
        return 0
    edge = np.zeros(n + 1, np.int64)
    edge[again] += 1
    edge[again + window] -= 1
    return int((np.cumsum(edge) > 0).sum())


def features_of(text: str | None) -> tuple[int, ...]:
    """The counts named in FEATURES; words are runs of anything but ASCII white space. Null and empty texts count nothing."""
    data = (text or "").encode()
    words = data.split()
    if not words:
        return (0,) * len(FEATURES)
    kinds = np.bincount(CLASSES[np.frombuffer(data, np.uint8)], minlength=7)
    lines = [line for line in data.split(b"\n") if line.strip()]
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words])
    return (
        len(words),
        int(len(data) - kinds[SPACE] - kinds[INSIDE]),
        int(kinds[SYMBOL]),
        len(lines) - len(set(lines)),
        repeated_words(ids),
        len(lines),
        int(kinds[UPPER]),
        int(kinds[LOWER]),
        int(kinds[MARK]),
        int((ids[1:] == ids[:-1]).sum()),
    )


def features(text: Column) -> Column:
    """struct of FEATURES for each text."""

    @F.arrow_udf("struct<" + ",".join(f"{n}:long" for n in FEATURES) + ">")
    def count(column: pa.Array) -> pa.Array:
        rows = [features_of(t) for _, texts in slices(column) for t in texts]
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * len(FEATURES), list(FEATURES))

    return count.asNondeterministic()(text.cast("string"))  # else a filter on it would count twice


def votes() -> list[str]:
    """SQL for each rule's vote on the feature columns: 0 bad, 1 abstain, 2 good."""
    return [f"CASE WHEN {bad} THEN 0 WHEN {good} THEN 2 ELSE 1 END" for _, bad, good in RULES]


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[float, np.ndarray]:
    """Log odds of good before any vote, and weights[rule, vote] to add, by expectation-maximisation over vote patterns.

    Starts from calling every document with a bad vote bad. Chances are of the votes cast, within the bounds WRONG and
    FINE; the weight of an abstention is 0. Without patterns all weights are 0.
    """
    patterns, counts = np.asarray(patterns, int), np.asarray(counts, float)
    rules = patterns.shape[1]
    bad_vote, cast = patterns == 0, patterns != 1
    good = (~bad_vote).all(1).astype(float)
    start, weights = 0.0, np.zeros((rules, 3))
    for _ in range(rounds):
        sure, rest = counts * good, counts * (1 - good)
        wrong = np.minimum(sure @ bad_vote, WRONG * (counts @ bad_vote))
        on_good = (wrong + SMOOTH) / (sure @ cast + 2 * SMOOTH)
        on_bad = np.minimum(1, (counts @ bad_vote - wrong + SMOOTH) / (rest @ cast + 2 * SMOOTH))
        start = float(np.log(sure.sum() + SMOOTH) - np.log(rest.sum() + SMOOTH))
        weights[:, 0] = np.log(on_good) - np.log(on_bad)
        weights[:, 2] = np.log(1 - on_good) - np.log(np.maximum(1 - on_bad, FINE))
        odds = start + sum(weights[r, patterns[:, r]] for r in range(rules))
        good = 1 / (1 + np.exp(-odds))
    return start, weights


def fit(counted: DataFrame) -> tuple[float, np.ndarray]:
    """The estimate from a table with the feature columns, of its rows that pass the base test; only the counts of vote patterns reach the driver."""
    names = [f"v{i}" for i in range(len(RULES))]
    seen = counted.where(f"NOT ({BASE_FAILED})").select(*[F.expr(v).alias(n) for v, n in zip(votes(), names, strict=True)]).groupBy(*names).agg(F.count(F.lit(1)).alias("c"))
    rows = sorted(tuple(r) for r in seen.collect())
    return estimate(np.array([r[:-1] for r in rows], int).reshape(len(rows), len(RULES)), np.array([r[-1] for r in rows], float))


def posterior(model: tuple[float, np.ndarray]) -> Column:
    """Probability of being good, from the feature columns."""
    start, weights = model
    odds = F.lit(float(start))
    for vote, (bad, none, good) in zip(votes(), weights.tolist(), strict=True):
        odds = odds + F.element_at(F.array(F.lit(bad), F.lit(none), F.lit(good)), F.expr(vote) + 1)
    return 1 / (1 + F.exp(-odds))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the counts, base_failed, quality (posterior) and kept of every document.

    Null and empty texts fail the base. Repeated rows are judged each and count each in the estimate; null ids are kept;
    an empty table gives no rows; other columns are ignored. No shuffle but for the vote patterns.
    """
    counted = materialize(docs.select(F.col(f"`{id_col}`").alias("doc_id"), features(F.col(f"`{text_col}`")).alias("f")).select("doc_id", "f.*"), "features")
    judged = counted.withColumns({"base_failed": F.expr(BASE_FAILED), "quality": posterior(fit(counted))})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def keep_good(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are kept, with their columns, whatever these are called.

    Null and empty texts fail the base test; repeated rows are judged, and kept, each; of an empty table nothing stays.
    Rows are written with their counts, so that texts pass through Python once; no text is shuffled.
    """
    held = docs.select(row_of(docs).alias("row"), features(F.col(f"`{text_col}`")).alias("f")).select("row", "f.*")
    held = materialize(held, "counted")
    return held.where(f"NOT ({BASE_FAILED})").where(posterior(fit(held)) >= threshold).select("row.*")


def oracle() -> str:
    """The query in SQL, with the expectation-maximisation as a recursive query over the vote patterns."""
    n = len(RULES)
    vs = ", ".join(f"v{i}" for i in range(n))
    word = r"[^\x20\x09-\x0D]+"

    total = lambda what, when: f"sum(CASE WHEN {when} THEN {what} ELSE 0 END) OVER ()"

    def weigh(v: str) -> str:
        every = total("c", f"{v} = 0")
        wrong = f"least({total('c * q', f'{v} = 0')}, {WRONG} * {every})"
        on_good = f"(({wrong} + {SMOOTH}) / ({total('c * q', f'{v} <> 1')} + {2 * SMOOTH}))"
        on_bad = f"least(1, ({every} - {wrong} + {SMOOTH}) / ({total('c * (1 - q)', f'{v} <> 1')} + {2 * SMOOTH}))"
        return f"CASE {v} WHEN 0 THEN ln({on_good}) - ln({on_bad}) WHEN 2 THEN ln(1 - {on_good}) - ln(greatest(1 - {on_bad}, {FINE})) ELSE 0 END"

    odds = f"ln(sum(c * q) OVER () + {SMOOTH}) - ln(sum(c * (1 - q)) OVER () + {SMOOTH}) + " + " + ".join(weigh(f"v{i}") for i in range(n))
    return f"""
    WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}') AS ws FROM documents),
    word AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM t),
    win AS (SELECT doc_id, unnest(range(1, len(ws) - {WINDOW - 2})) AS i, ws FROM t WHERE len(ws) >= {WINDOW}),
    named AS (SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS k FROM win),
    again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM named) WHERE c > 1),
    rep AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS j FROM again) GROUP BY doc_id),
    wordly AS (SELECT doc_id, count(*) AS n_words, sum(length(w)) AS word_chars,
                      sum(CASE WHEN w = p THEN 1 ELSE 0 END) AS n_runs
               FROM (SELECT doc_id, w, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM word) GROUP BY doc_id),
    line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM t),
    liny AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM line WHERE regexp_matches(l, '{word}') GROUP BY doc_id),
    f AS (SELECT t.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
                 length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
                 coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_runs, 0) AS n_runs,
                 length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^a-z]', '', 'g')) AS n_lower,
                 length(regexp_replace(text, '[^!?]', '', 'g')) AS n_marks
          FROM t LEFT JOIN wordly USING (doc_id) LEFT JOIN liny USING (doc_id) LEFT JOIN rep USING (doc_id)),
    voted AS (SELECT *, {", ".join(f"{v} AS v{i}" for i, v in enumerate(votes()))} FROM f),
    em AS (SELECT 0 AS step, {vs}, count(*)::DOUBLE AS c, (CASE WHEN {" OR ".join(f"v{i} = 0" for i in range(n))} THEN 0 ELSE 1 END)::DOUBLE AS q FROM voted WHERE NOT ({BASE_FAILED}) GROUP BY {vs}
           UNION ALL SELECT step + 1, {vs}, c, 1 / (1 + exp(-({odds}))) FROM em WHERE step < {ROUNDS})
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({BASE_FAILED}) AS base_failed, NOT ({BASE_FAILED}) AND coalesce(q >= {THRESHOLD}, FALSE) AS kept
    FROM voted LEFT JOIN (SELECT {vs}, q FROM em WHERE step = {ROUNDS}) USING ({vs})"""
