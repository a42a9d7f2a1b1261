import collections
import random
import re

import duckdb
import numpy as np
import pytest

from quillspark.llm import quality
from quillspark.llm.quality import FEATURES, features_of, judge, keep_good, repeated_words

TEXTS = [None, "", " \n\t ", "one", "Über\x0bstraße 漢字", "a b c\na b c\n \n\na b c", "x " * 40, "## ** word | a | b", "A! B? c d e", "the " * 9 + "end", "word other " * 30]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    c = collections.Counter(wins)
    covered = {i + k for i, w in enumerate(wins) if c[w] > 1 for k in range(8)}
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered), len(lines),
        len(re.findall("[A-Z]", text)), len(re.findall("[a-z]", text)), len(re.findall("[!?]", text)), sum(a == b for a, b in zip(words, words[1:], strict=False)),
    )


def test_features():
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choice("ab") + rng.choice(["", "\n", "!"]) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    for t in texts:
        got = features_of(t)
        want = brute(t)
        assert got == (want if want[0] else (0,) * len(FEATURES)), t


def test_repeated_words_any_window():
    rng = random.Random(2)
    for _ in range(200):
        ids = [rng.randint(0, 2) for _ in range(rng.randint(0, 40))]
        w = rng.randint(2, 9)
        wins = [tuple(ids[i : i + w]) for i in range(len(ids) - w + 1)]
        covered = {i + k for i, x in enumerate(wins) if wins.count(x) > 1 for k in range(w)}
        assert repeated_words(np.array(ids, int), w) == len(covered)


def test_estimate_finds_bad_rules():
    rng = np.random.default_rng(1)
    good = rng.random(20000) < 0.8
    hit = lambda bad, fine: np.where(good, rng.choice(3, 20000, p=fine), rng.choice(3, 20000, p=bad))
    v = np.stack([hit([0.6, 0.2, 0.2], [0.02, 0.1, 0.88]), hit([0.5, 0.4, 0.1], [0.01, 0.3, 0.69]), hit([0.7, 0.0, 0.3], [0.03, 0.0, 0.97])], 1)
    patterns, counts = np.unique(v, axis=0, return_counts=True)
    start, weights = quality.estimate(patterns, counts)
    odds = start + sum(weights[r, v[:, r]] for r in range(3))
    assert ((odds > 0) == good).mean() > 0.93
    # The share of good documents is estimated where the rules keep within the bounds: a bad document passes half the rules that judge it.
    v = np.stack([hit([0.4, 0.2, 0.4], [0.01, 0.2, 0.79]) for _ in range(6)], 1)
    patterns, counts = np.unique(v, axis=0, return_counts=True)
    start, weights = quality.estimate(patterns, counts)
    odds = start + sum(weights[r, v[:, r]] for r in range(6))
    assert ((odds > 0) == good).mean() > 0.93
    assert abs(1 / (1 + np.exp(-start)) - 0.8) < 0.05


def test_two_kinds_of_junk():
    """A kind that fails one rule stays junk beside a kind that fails two others, at any size."""
    patterns = np.array([[2, 2, 2, 2], [0, 0, 2, 2], [2, 2, 0, 2], [1, 2, 1, 1]])
    for scale in (1, 1000):
        start, weights = quality.estimate(patterns, np.array([60, 8, 8, 4]) * scale)
        odds = start + np.array([sum(weights[r, p[r]] for r in range(4)) for p in patterns])
        assert ((odds > 0) == [True, False, False, True]).all()


def test_abstentions_are_no_evidence():
    rng = np.random.default_rng(4)
    good = rng.random(5000) < 0.7
    v = np.stack([np.where(good, rng.choice(3, 5000, p=[0.05, 0.3, 0.65]), rng.choice(3, 5000, p=[0.7, 0.1, 0.2])) for _ in range(4)], 1)
    patterns, counts = np.unique(v, axis=0, return_counts=True)
    start, weights = quality.estimate(patterns, counts)
    assert (weights[:, 1] == 0).all() and (weights[:, 2] > 0).all() and (weights[:, 0] < 0).all()
    silent = np.column_stack([patterns, np.ones(len(patterns), int)])  # a rule that never votes changes nothing
    again, more = quality.estimate(silent, counts)
    assert again == pytest.approx(start) and np.allclose(more[:-1], weights) and (more[-1] == 0).all()
    quiet = np.array([[1, 1, 1, 1]])
    assert quality.estimate(quiet, [10])[1].tolist() == np.zeros((4, 3)).tolist()


#: Clean paragraphs in languages and scripts that no rule knows of.
CLEAN = [
    "La mattina il mercato si riempie di voci e di colori, mentre i contadini dispongono frutta e verdura sui banchi di legno e salutano i clienti che conoscono da anni.",
    "Wczesnym rankiem rybacy wypływają na jezioro, a ich łodzie suną cicho po wodzie; na brzegu zostają dzieci, które zbierają kamienie i czekają na powrót ojców do domu.",
    "Kesällä perhe muutti pieneen mökkiin järven rannalle, ja joka ilta he istuivat laiturilla katsellen, kuinka aurinko laski hitaasti metsän taakse ja linnut vaikenivat yksi kerrallaan pois.",
    "Ранним утром поезд остановился на маленькой станции, и пассажиры вышли на платформу, чтобы купить горячий чай и свежие пирожки, пока машинист проверял колёса и разговаривал с дежурным.",
    "Το καλοκαίρι οι κάτοικοι του χωριού μαζεύονται στην πλατεία κάτω από τον πλάτανο, πίνουν καφέ και συζητούν για τη σοδειά, τον καιρό και τα παιδιά που έφυγαν στην πόλη.",
    "في الصباح الباكر يفتح التجار دكاكينهم في السوق القديم ويعرضون التوابل والأقمشة على الطاولات بينما يمر الناس بين الأزقة الضيقة باحثين عن الخبز الطازج والقهوة والفاكهة الموسمية اللذيذة جدا.",
    "सुबह होते ही किसान अपने खेतों की ओर निकल पड़ते हैं और बच्चे किताबें लेकर पाठशाला जाते हैं जबकि गाँव की औरतें कुएँ से पानी भरकर घर लौटती हैं और चूल्हा जलाती हैं।",
    "아침 일찍 시장에 나온 상인들은 신선한 채소와 생선을 가지런히 놓고 손님을 기다렸으며 아이들은 골목에서 공을 차며 놀았고 노인들은 나무 그늘 아래 앉아 지난 이야기를 천천히 나누었다 그리고 웃었다.",
    "我们 清晨 出发 沿着 河边 的 小路 一直 走到 山脚 下 的 村庄 那里 的 人们 正在 收割 稻子 孩子 们 在 田埂 上 追逐 老人 坐在 门口 喝茶 聊天",
    "朝早く 私たちは 駅を出て 川沿いの道を 山のふもとの村まで 歩いた。 村では 人々が 稲を刈り、 子どもたちは あぜ道で 遊び、 お年寄りは 縁側で お茶を 飲みながら 昔話を していた。 夕方には みんなで 温泉に 入り、 静かな夜を 迎えた。",
]


def test_clean_texts_of_unlisted_languages_stay(spark, docs):
    """Among prose of another language and junk, and as a small minority."""
    alien = [(1000 + i, t, None) for i, t in enumerate(CLEAN)]
    got = judge(docs.unionByName(spark.createDataFrame(alien, docs.schema))).where("doc_id >= 1000").collect()
    assert len(got) == len(CLEAN) and all(not r.base_failed and r.kept for r in got), [(r.doc_id, r.quality) for r in got if not r.kept]


def test_very_long_text_and_clashing_columns(spark):
    rng = random.Random(8)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(200_000))
    rows = spark.createDataFrame([(1, text, "a", "b"), (2, None, "c", "d")], "doc_id long, text string, f string, `row` string")
    r = judge(rows).where("doc_id = 1").first()
    assert r.n_words == 200_000 and r.kept
    assert [tuple(r)[2:] for r in keep_good(rows).collect()] == [("a", "b")]


def test_texts_pass_through_python_once(spark, docs, capsys):
    keep_good(docs).explain()
    assert "ArrowEvalPython" not in capsys.readouterr().out  # the counts are read back from the table written with the rows


@pytest.fixture
def docs(spark):
    rng = random.Random(3)
    words = [a + b for a in ("tha", "ren", "ing", "sto") for b in ("re", "ly", "ou", "nd", "st")] + ["the", "of", "and"]
    prose = [" ".join(rng.choice(words) for _ in range(rng.randint(60, 200))) for _ in range(60)]
    junk = [" ".join(rng.choice(words).upper() + "!!" for _ in range(80)) for _ in range(8)] + [" ".join(rng.choice(words) + "###" for _ in range(80)) for _ in range(8)]
    rows = [(i, t, "x") for i, t in enumerate(TEXTS + prose + junk + prose[:5])] + [(None, prose[0], "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string")


def test_judge_and_filter(docs):
    got = judge(docs).collect()
    for r in got:
        if r.doc_id is not None:
            t = docs.where(docs.doc_id == r.doc_id).first().text
            assert tuple(r[n] for n in FEATURES) == features_of(t)
    kept = sorted(r.doc_id for r in got if r.kept and r.doc_id is not None)
    assert set(range(len(TEXTS), len(TEXTS) + 60)) <= set(kept)
    assert not {r.doc_id for r in got if r.doc_id in range(len(TEXTS) + 60, len(TEXTS) + 76)} & set(kept)
    held = keep_good(docs)
    assert held.columns == docs.columns
    assert sorted(r.doc_id for r in held.collect() if r.doc_id is not None) == kept
    assert judge(docs.limit(0)).collect() == [] == keep_good(docs.limit(0)).collect()


def test_sql(docs):
    got = sorted((r.doc_id, *(r[n] for n in quality.BASE), r.base_failed, r.kept) for r in judge(docs.where("doc_id is not null")).collect())
    documents = docs.where("doc_id is not null").toPandas()  # noqa: F841
    assert got == sorted(duckdb.sql(quality.oracle()).fetchall())
