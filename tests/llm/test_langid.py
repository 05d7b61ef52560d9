import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from placeloom.llm import langid

rng = random.Random(3)
TONGUES = {"en": "the of and ing ed er tion in a to is".split(), "fr": "le la de é eau ou è que ç des oi".split(), "de": "der und ü sch ein ung ä ß ich zu".split()}


def text(lang, n=60):
    return " ".join("".join(rng.choices(TONGUES[lang], k=rng.randrange(1, 4))) for _ in range(n)).capitalize() + "."


def brute_kn(texts, order):
    """Probability by the textbook recursion over explicit counts."""
    top = Counter()
    for t in texts:
        top += langid.grams(t, order)
    counts = {order: top}
    for m in range(order - 1, 0, -1):
        counts[m] = Counter(g[1:] for g in counts[m + 1])
    discount = {}
    for m, c in counts.items():
        n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        discount[m] = min(0.95, max(0.05, n1 / (n1 + 2 * n2) if n1 else 0.5))
    by = {m: defaultdict(lambda: [0, 0]) for m in counts}
    for m, c in counts.items():
        for g, n in c.items():
            by[m][g[:-1]][0] += n
            by[m][g[:-1]][1] += 1

    def p(g, size):
        if not g:
            return 1 / size
        m = len(g)
        total, kinds = by[m].get(g[:-1], (0, 0)) if g[:-1] in by[m] else (0, 0)
        if not total:
            return p(g[1:], size)
        return max(counts[m][g] - discount[m], 0) / total + discount[m] * kinds / total * p(g[1:], size)

    return p


@pytest.mark.parametrize("order", [2, 3, 5])
def test_models_equal_the_recursion(order):
    train = {k: [text(k) for _ in range(6)] for k in TONGUES}
    counts = {k: dict(sum((langid.grams(t, order) for t in v), Counter())) for k, v in train.items()}
    models = langid.estimate(counts, order)
    tests = [text("en"), text("fr", 3), "zzz qqq", "the", "Été 12 ein--und", "漢字 the"]
    entropy, size = langid.Scorer(models).score(tests)
    n_ids = len(models.alphabet) + langid.FIRST
    known = set(models.alphabet) | {" ", "\x01"}
    for at, lang in enumerate(models.languages):
        p = brute_kn(train[lang], order)
        for i, t in enumerate(tests):
            s = "".join(" " if c == 0 else chr(c) for c in langid.squeezed(langid.code_points(t)).tolist())
            s = "\x01" * (order - 1) + "".join(c if c in known else "\x02" for c in s)
            want = [-math.log(p(s[k : k + order], n_ids)) for k in range(len(s) - order + 1)]
            assert size[i] == len(want)
            assert entropy[i, at] == pytest.approx(sum(want) / len(want), rel=1e-5)


def test_probabilities_sum_to_one():
    counts = {k: dict(langid.grams(text(k, 300), 3)) for k in TONGUES}
    m = langid.estimate(counts, 3)
    ids = np.array([list(m.alphabet.values())[:2] + [c] for c in range(len(m.floor))], np.uint64)
    rows = langid.Scorer(m).rows(ids.reshape(-1), np.arange(len(ids)) * 3 + 2)
    assert np.exp(rows.astype(float)).sum(0) == pytest.approx(np.ones(3), rel=1e-4)


def test_long_text_in_pieces(monkeypatch):
    m = langid.estimate({k: dict(langid.grams(text(k, 300), 4)) for k in TONGUES}, 4)
    texts = [text("en", 400), "", text("de", 5), None, text("fr", 300)]
    whole = langid.Scorer(m).score(texts)
    monkeypatch.setattr(langid, "BATCH_CHARS", 61)
    pieces = langid.Scorer(m).score(texts)
    assert np.allclose(whole[0], pieces[0]) and (whole[1] == pieces[1]).all()


def test_identify(spark):
    rows = [(i, text(k), k if i % 7 else None) for i, k in enumerate(list(TONGUES) * 120)]
    rows += [(1000, None, "en"), (1001, "", None), (1002, "123 %%", "fr"), (1003, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(400)), None), (None, text("de"), "de"), (1000, text("fr"), "fr")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string").repartition(4)
    models = langid.fit(df)
    got = langid.identify(df, models).collect()
    assert len(got) == len(rows)
    truth = {i: k for i, k in enumerate(list(TONGUES) * 120)}
    for r in got:
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if r.doc_id in truth:
            assert r.lang_pred == truth[r.doc_id] and not r.rejected and 0.5 < r.score <= 1
    odd = {r.doc_id: r for r in got if r.doc_id in (1001, 1002, 1003)}
    assert odd[1001].lang_pred == odd[1002].lang_pred == "und" and odd[1002].score == 0
    assert all(r.rejected for r in odd.values())
    assert langid.identify(df.limit(0), models).count() == 0
    none = langid.fit(df.where("lang is null"))
    assert {r.lang_pred for r in langid.identify(df.limit(5), none).collect()} == {"und"}


def test_marks_alone_are_no_letters(spark):
    m = langid.estimate({k: dict(langid.grams(text(k, 300) + " e\u0301", 4)) for k in TONGUES}, 4)
    texts = ["\u0301\u0301 \u0300", "12 \u0301", " " * 70 + "\u0301", " " * 70 + "e\u0301", "e\u0301"]
    assert (langid.Scorer(m).score(texts)[1] > 0).tolist() == [False, False, False, True, True]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.lang_pred == "und" for r in langid.identify(df, m).orderBy("doc_id").collect()] == [True, True, True, False, False]


def test_fit_is_bounded_in_characters(spark):
    rows = [(i, text(k, 200), k) for i, k in enumerate(list(TONGUES) * 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    few, all_ = langid.fit(df, chars_a_language=20_000), langid.fit(df)
    assert 0 < len(few.probs[5].hashes) < 0.8 * len(all_.probs[5].hashes) and few.languages == all_.languages


def test_held_out_accuracy(spark, sf_small):
    df = spark.read.parquet(f"{sf_small}/documents.parquet")
    got = langid.identify(df, langid.fit(df), keep=("lang",)).where("held_out and lang is not null").selectExpr("avg(double(lang = lang_pred)) as a", "avg(double(rejected)) as r").first()
    assert got.a > 0.98 and got.r < 0.02
