"""Language ID: held-out accuracy, families, edge cases."""

import random
import zlib

import numpy as np
import pytest

from tablewright.llm import langid

WORDS = {
    "en": "the of and to in is that with was for this have from they which would there their what about could",
    "de": "der die und das nicht mit sich auf ist von dem werden eine auch nach wird bei einer durch noch",
    "fr": "les des est dans que une pour pas qui sur avec plus tout mais nous cette leurs aussi entre deux",
    "es": "los las una por con para del como pero sus este entre cuando muy sin sobre hasta hay donde quien",
    "xx": "zqa zqo wxu wxi qzqz xwxw zaza quqx",
}


def corpus(n, seed):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(WORDS[l].split(), k=30)).capitalize(), l) for i, l in enumerate(rng.choices(list(WORDS), k=n))]


@pytest.fixture(scope="module")
def model(spark):
    rows = corpus(600, 1) + [(10_000, None, "en"), (10_001, "12 34", "de"), (10_002, "text", None), (None, "the of", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.fit(df.limit(0)) is None
    return langid.fit(df)


def test_held_out_accuracy(spark, model):
    df = spark.createDataFrame(corpus(300, 2), "doc_id long, text string, lang string")
    got = {r.id: r for r in langid.predict(df, model).collect()}
    right = [got[i].lang_pred == l for i, _, l in corpus(300, 2)]
    assert sum(right) / len(right) > 0.98 and all(0 <= r.score <= 1 for r in got.values())
    assert model.members["germanic"] == ["de", "en"] and model.members["xx"] == ["xx"]


def test_edge_cases(spark, model):
    rows = [(1, None, "a"), (2, "", "a"), (3, "12 .. 34", "a"), (4, "the", "a"), (None, "der und die", "a"), (6, "les des est " * 40000, "a"), (7, "é", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = {r.id: r for r in langid.predict(df, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0
    assert got[None].lang_pred == "de" and got[6].lang_pred == "fr" and got[7].lang_pred != "und"
    assert langid.predict(df.limit(0), model).count() == 0
    assert {r.lang_pred for r in langid.predict(df, None).collect()} == {"und"}


def test_one_language_and_folds(spark):
    df = spark.createDataFrame([(i, "hello there", "en") for i in range(20)], "doc_id long, text string, lang string")
    assert langid.predict(df, langid.fit(df)).first().lang_pred == "en"
    fold = [r[0] for r in df.select(langid.bucket("doc_id", 5)).collect()]
    assert fold == [zlib.crc32(str(i).encode()) % 5 for i in range(20)]


def plain_features(text):
    """Pairs and triples counted one by one."""
    data = b" " + text.encode() + b" "
    folded = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in data]
    out = []
    for b in folded:
        if b != 32 or not out or out[-1] != 32:
            out.append(b)
    x = [0.0] * langid.BINS
    for i in range(len(out) - 1):
        x[((out[i] * 256 + out[i + 1]) * 2654435761 % 2**32) >> 21] += 1
    for i in range(len(out) - 2):
        x[langid.BINS // 2 + ((((out[i] * 256 + out[i + 1]) * 256 + out[i + 2]) * 2246822519 % 2**32) >> 21)] += 1
    norm = sum(x) ** 0.5
    return np.array([v**0.5 / norm for v in x])


def plain_svm(x, y):
    """The same steps, a machine at a time, in double precision."""
    x = np.c_[x, np.ones(len(x))]
    cost = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
    w = last = np.zeros(x.shape[1])
    for k in range(200):
        v = w + k / (k + 3) * (w - last)
        gradient = 1e-3 * v
        for row, side, c in zip(x, y, cost):
            gradient = gradient - 2 * c * max(0.0, 1 - side * (row @ v)) * side * row
        last, w = w, v - 0.2 * gradient
    return w


def test_predictions_match_a_plain_version(spark):
    rows = [(i, t, l) for i, t, l in corpus(60, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    learned = [(t, l) for i, t, l in rows if zlib.crc32(str(i).encode()) % 5]
    x, langs = np.array([plain_features(t) for t, _ in learned]), np.array([l for _, l in learned])
    assert np.allclose(x, [langid.features(t) for t, _ in learned], atol=1e-6)
    x = x.astype(np.float16).astype(float)
    families = {"germanic": ["de", "en"], "romance": ["es", "fr"], "xx": ["xx"]}
    sure = lambda w, v: 1 / (1 + np.exp(-4 * np.clip(v @ w[:-1] + w[-1], -20, 20)))
    of_family = {f: plain_svm(x, np.where(np.isin(langs, m), 1.0, -1.0)) for f, m in families.items()}
    pairs = {}
    for m in families.values():
        for a, b in [m] if len(m) == 2 else []:
            some = np.isin(langs, m)
            pairs[a, b] = plain_svm(x[some], np.where(langs[some] == a, 1.0, -1.0))
    got = {r.id: r for r in langid.predict(df, model).collect()}
    for i, t, _ in rows:
        v = plain_features(t)
        p = {f: sure(w, v) for f, w in of_family.items()}
        best = max(sorted(p), key=p.get)
        score, lang = p[best] / sum(p.values()), families[best][0]
        if len(families[best]) == 2:
            q = sure(pairs[tuple(families[best])], v)
            lang, score = families[best][0 if q >= 0.5 else 1], score * max(q, 1 - q)
        assert got[i].lang_pred == lang and abs(got[i].score - score) < 1e-3


def test_the_sample_is_bounded_and_every_language_is_learned(spark, monkeypatch):
    """130 languages, one id with a third of all rows and copies of one text: the same rows each time, all languages."""
    rows = [(3 if i % 3 == 0 else i, ("copy of one text" if i % 2 else f"text number w{i} of lang") + f" l{i % 130}", f"l{i % 130}") for i in range(2600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(langid, "Model", lambda x, langs: seen.append((x, langs)))
    langid.fit(df, sample=400)
    langid.fit(df.repartition(7), sample=400)
    langid.fit(df, sample=50)
    (x, langs), (y, again), (_, few) = seen
    learned = {l for i, _, l in rows if zlib.crc32(str(i).encode()) % 5}
    assert set(langs) == learned and len(langs) <= 400 and max(list(langs).count(l) for l in learned) <= 3
    assert np.array_equal(x, y) and list(langs) == list(again) and 40 <= len(few) <= 50
