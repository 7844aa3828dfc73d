import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import mil_quality as m


@pytest.fixture(scope="module")
def labelled(spark, prose):
    rows, labels = [], []
    for k in range(160):
        bad = k % 2
        text = " ".join(w.upper() + "!!" for w in prose(k, 150).split()) if bad else prose(k, 150)
        rows.append((k, text))
        labels.append((k, 1 - bad))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_learns_and_holds_out(spark, labelled):
    docs, labels = labelled
    model = m.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in m.score(docs, model).collect()}
    held = [k for k in got if zlib.crc32(str(k).encode()) % 5 == 0]
    assert held and all((got[k] >= m.CUTOFF) == (k % 2 == 0) for k in held)
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    again = {r["doc_id"]: r["score"] for r in m.score(docs, m.train(docs, flipped)).collect()}
    assert again == got


def test_odd_rows(spark, labelled, odd_docs):
    model = m.train(*labelled)
    out = m.score(odd_docs, model)
    rows = out.collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows) and out.columns == odd_docs.columns
    twins = [r["score"] for r in rows if r["doc_id"] == 5]
    assert twins[0] == twins[1]
    assert m.score(odd_docs.limit(0), model).isEmpty()


def test_without_labels(spark, labelled):
    docs, labels = labelled
    for some, want in ((labels.limit(0), 1.0), (labels.where("quality = 0"), 0.0), (spark.createDataFrame([(None, 1), (3, None)], "doc_id long, quality int"), 1.0)):
        assert {r["score"] for r in m.score(docs, m.train(docs, some)).collect()} == {want}


def test_parts_of_long_texts_merge(prose, monkeypatch):
    rng = np.random.default_rng(0)
    model = m.GatedAttention()
    model.mean = rng.normal(0, 0.01, m.N_FEATURES)
    text = prose(5, 64 * 40).encode()
    whole = model.score([text, b"a b"])
    # cut between passages, the parts hold the same passages
    words = text.split()
    x, _ = m.passages([text])
    y, owner = m.passages([b" ".join(words[: 64 * 10]), b" ".join(words[64 * 10 :])])
    assert len(x) == len(y) == 40 and owner.tolist() == [0] * 10 + [1] * 30
    monkeypatch.setattr(m, "CHUNK_BYTES", 3000)
    assert np.allclose(model.score([text, b"a b"]), whole, atol=0.02)


def slow_passages(text):
    """Features of each passage by plain loops."""
    data = (text or b"") + b"\n"
    words = list(re.finditer(rb"[^\x09-\x0d\x20]+", data))
    if not words:
        return [[0.0] * m.N_FEATURES]
    out = []
    for at in range(0, len(words), m.PASSAGE_WORDS):
        own = words[at : at + m.PASSAGE_WORDS]
        end = words[at + m.PASSAGE_WORDS].start() if at + m.PASSAGE_WORDS < len(words) else len(data)
        part = data[own[0].start() : end]
        row = [0.0] * m.N_FEATURES
        for c in part:
            row[0 if 97 <= c <= 122 else 1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 4 if c > 127 else 5 if c == 10 else 6 + m._SIGNS.index(c) if c in m._SIGNS else 3] += 1 / len(part)
        for c, d in zip(part, part[1:]):
            row[m._CLASSES + ((c * 31 + d * 17 + (c >> 3)) & (m._BIGRAMS - 1))] += 1 / len(part)
        texts = [w.group() for w in own]
        lengths = [len(w) for w in texts]
        mean = sum(lengths) / len(lengths)
        spread = math.sqrt(sum((x - mean) ** 2 for x in lengths) / len(lengths))
        again = sum(a == b for a, b in zip(texts, texts[1:]))
        row[-6:] = [mean / 10, spread / 10, again / len(texts), len(set(texts)) / len(texts), sum(w[:1].isupper() and w[0] < 128 for w in texts) / len(texts), min(1, len(texts) / m.PASSAGE_WORDS)]
        out.append(row)
    return out


def test_features_and_scores_against_plain_loops(spark, labelled, odd_docs, prose):
    model = m.train(*labelled)
    texts = [None if r["text"] is None else r["text"].encode() for r in odd_docs.collect() if len(r["text"] or "") < 60_000]
    texts += [b"a a a B!! #\n\nx 12 <b> " * 40, prose(4, 64).encode(), (prose(5, 65) + " \n ").encode()]
    for text in texts:
        assert np.allclose(m.passages([text or b""])[0], slow_passages(text), atol=1e-5)
    got = model.score([t or b"" for t in texts])
    for text, score in zip(texts, got):
        x = (np.array(slow_passages(text)) - model.mean) / model.scale
        h = np.tanh(x @ model.p["A"] + model.p["a"])
        e = [sum(w * math.tanh(t) / (1 + math.exp(-u)) for w, t, u in zip(model.p["w"], row @ model.p["V"], row @ model.p["U"])) for row in h]
        weight = [math.exp(v - max(e)) for v in e]
        z = sum(w * row for w, row in zip(weight, h)) / sum(weight)
        assert abs(score - 1 / (1 + math.exp(-(float(z @ model.p["c"]) + float(model.p["b"][0]))))) < 1e-4


def test_the_sample_is_bounded_in_whole_texts(spark, labelled, prose, monkeypatch):
    docs, labels = labelled
    long = docs.union(spark.createDataFrame([(1000, prose(3, 64 * 50)), (1001, None)], "doc_id long, text string"))
    marks = labels.union(spark.createDataFrame([(1000, 1), (1001, 0)], "doc_id long, quality int"))
    seen = []
    fit = m.GatedAttention.fit
    monkeypatch.setattr(m.GatedAttention, "fit", lambda self, x, bag, y: seen.append((len(x), np.bincount(bag))) or fit(self, x, bag, y))
    m.train(long, marks, fold=lambda c: F.lit(True))
    m.train(long, marks, max_passages=49, fold=lambda c: F.lit(True))
    m.train(long, marks, max_docs=7, fold=lambda c: F.lit(True))
    assert sorted(seen[0][1]) == [1, *[3] * 160, 50] and seen[1][0] <= 49 and set(seen[1][1]) <= {1, 3} and seen[1][0] >= 46 and len(seen[2][1]) == 7


def test_gradient():
    rng = np.random.default_rng(1)
    model = m.GatedAttention()
    x, first, y = rng.normal(size=(7, m.N_FEATURES)), np.array([0, 3]), np.array([1.0, 0.0])
    grad = model._gradient(x, first, y)

    def loss():
        h, _, _, e = model._embed(x)
        total = 0.0
        for a, b, t in ((0, 3, 1.0), (3, 7, 0.0)):
            w = np.exp(e[a:b]) / np.exp(e[a:b]).sum()
            p = 1 / (1 + np.exp(-(w @ h[a:b] @ model.p["c"] + model.p["b"][0])))
            total -= t * np.log(p) + (1 - t) * np.log(1 - p)
        return total / 2

    for name in model.p:
        at = tuple(0 for _ in model.p[name].shape)
        kept = model.p[name][at]
        model.p[name][at] = kept + 1e-6
        up = loss()
        model.p[name][at] = kept - 1e-6
        assert abs((up - loss()) / 2e-6 - grad[name][at]) < 1e-5, name
        model.p[name][at] = kept
