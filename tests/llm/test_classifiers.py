import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from depthframe.llm import quality, toxicity
from depthframe.llm.sampling import training_rows


@pytest.fixture(scope="module")
def tables(spark, testdata):
    return spark.read.parquet(f"{testdata}/sf0.1/documents.parquet"), spark.read.parquet(f"{testdata}/sf0.1/labels.parquet")


def accuracy(found, labels, label):
    rows = found.where("held_out").join(labels.where(F.col(label).isNotNull()), "doc_id").select("score", "predicted", F.col(label).alias("y")).collect()
    ones, zeros = [r.score for r in rows if r.y == 1], [r.score for r in rows if r.y == 0]
    auc = sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))
    return auc, sum(r.predicted == r.y for r in rows) / len(rows)


@pytest.mark.parametrize(("module", "label", "auc", "right"), [(quality, "quality", 0.9, 0.93), (toxicity, "toxic", 0.94, 0.95)])
def test_held_out_accuracy(tables, module, label, auc, right):
    docs, labels = tables
    found = module.classify(docs, labels).persist()
    assert found.count() == docs.count()
    got = accuracy(found, labels, label)
    print(label, got)
    assert got[0] >= auc and got[1] >= right
    sample = found.limit(50).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in sample)
    assert all(r.predicted == int(r.score >= module.THRESHOLD) for r in sample)


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_edge_rows(spark, module, label):
    rows = [(1, None), (2, ""), (3, "x" * 300_000), (4, "a b"), (4, "a b"), (None, "c"), (5, "\U0001f600 é")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS label", "3 AS words")
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    one = spark.createDataFrame([(1, 1), (3, 1), (None, 0)], f"doc_id long, {label} int")
    two = spark.createDataFrame([(1, 1), (3, 0), (4, 0), (5, None), (4, 1)], f"doc_id long, {label} int")
    for labels in (none, one, two):
        got = module.classify(df, labels).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in rows)
        assert all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id == 4}) == 1
    assert module.classify(df.where("false"), two).count() == 0


def test_keep_good(spark, tables):
    docs, labels = tables
    kept = quality.keep_good(docs, labels)
    assert kept.schema == docs.schema
    good = labels.where("quality = 1").join(docs, "doc_id").count()
    assert kept.join(labels.where("quality = 1"), "doc_id").count() >= 0.97 * good


M = (1 << 64) - 1


def plain_ngrams(text):
    """Hashed n-grams one at a time."""
    codes = [32 if 9 <= ord(c) <= 13 else ord(c) for c in f" {(text or '').lower()} "]
    out = set()
    for n in (4, 5, 6):
        for k in range(len(codes) - n + 1):
            x = 0
            for c in codes[k : k + n]:
                x = (x * 0x9E3779B97F4A7C15 + c) & M
            x = (x + n) & M
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M
            x = (x ^ x >> 27) * 0x94D049BB133111EB & M
            out.add((x ^ x >> 31) >> 46)
    return out


def test_toxicity_by_plain_code(spark, monkeypatch):
    """N-grams, log-count ratios, the fitted model and every score, recomputed one by one."""
    monkeypatch.setattr(toxicity, "STEP", 16)
    rng = random.Random(3)
    words = ["calm", "Étude", "fine\tday", "awful", "vile!", "river"]
    rows = [(k, " ".join(rng.choices(words, [4, 3, 3, 1, 1, 3] if k % 3 else [1, 1, 1, 5, 5, 1], k=rng.randint(0, 30)))) for k in range(90)]
    label = {k: int(k % 3 == 0) for k, _ in rows}
    seen = np.zeros(1 << toxicity.BITS, bool)
    for _, t in [*rows, (0, None), (0, "𝒳" * 50)]:
        assert set(toxicity.ngrams(t, seen).tolist()) == plain_ngrams(t) and not seen.any()

    learnt = [(k, t) for k, t in rows if zlib.crc32(str(k).encode()) % 4 != 2]
    held = np.zeros((2, 1 << toxicity.BITS))
    for k, t in learnt:
        for g in plain_ngrams(t):
            held[label[k], g] += 1
    ones = sum(label[k] for k, _ in learnt)
    kept, ratio = toxicity.choose(held, np.array([len(learnt) - ones, ones]))
    size = 1 << toxicity.BITS
    for g in (int(kept[0]), int(kept[-1])):
        want = math.log((held[1, g] + 1) / (held[1].sum() + size)) - math.log((held[0, g] + 1) / (held[0].sum() + size))
        assert abs(ratio[g] - want) < 1e-9
    holds = [plain_ngrams(t) for _, t in learnt]
    bits = np.array([[g in h for g in kept.tolist()] for h in holds])
    model = toxicity.fit_bits(bits, np.array([label[k] for k, _ in learnt]), kept, ratio)

    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(list(label.items()), "doc_id long, toxic int")
    got = toxicity.classify(docs, labels).collect()
    for r in got:
        margin = model.intercept + sum(float(model.weights[g]) for g in plain_ngrams(rows[r.doc_id][1]))
        assert abs(r.score - 1 / (1 + math.exp(-margin))) < 1e-6
    assert sum(r.predicted == label[r.doc_id] for r in got) > 75


def plain_statistics(text):
    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    if not words:
        return [0.0] * 15
    n = len(raw)
    share = lambda pattern: len(re.findall(pattern, raw)) / n
    lines = [x for x in raw.split(b"\n") if re.search(rb"[^\x20\x09-\x0D]", x)]
    return [
        math.log(1 + n), math.log(1 + len(words)), sum(len(w) for w in words) / len(words),
        share(rb"[A-Z]"), share(rb"[0-9]"), share(rb"""[!-/:-@\[-`{-~]"""), share(rb"\|"), share(rb"!"), share(rb"""[$%&#*@^~<>{}\[\]\\]"""), share(rb"[\x80-\xff]"),
        math.log(1 + n / len(lines)), 1 - len(set(lines)) / len(lines), len(set(words)) / len(words), max(Counter(words).values()) / len(words),
        sum(x.strip(b" \t\r\x0b\x0c")[-1:] in (b".", b"!", b"?", b'"', b"'") for x in lines) / len(lines),
    ]


def test_quality_by_plain_code(spark, tables):
    """Statistics, and the rules' columns with their weights, recomputed row by row."""
    docs, labels = tables
    some = docs.where("doc_id % 37 = 0")
    texts = {r.doc_id: r.text for r in some.collect()}
    got = {r.doc_id: r for r in quality.statistics(some.select("doc_id", "text")).collect()}
    for i, t in texts.items():
        assert np.allclose([got[i][s] for s in quality.STATISTICS], plain_statistics(t), rtol=1e-12, atol=0), i
    model = quality.fit(docs, labels)
    assert model.rules and all(abs(w) > 0 for _, w in model.rules)
    scores = {r.doc_id: r.score for r in quality.statistics(some.select("doc_id", "text")).select("doc_id", model.column().alias("score")).collect()}
    for i, t in texts.items():
        at = dict(zip(quality.STATISTICS, plain_statistics(t), strict=True))
        total = model.intercept + sum(w for rule, w in model.rules if all(at[n] > b if up else at[n] <= b for n, b, up in rule.bounds))
        assert abs(scores[i] - 1 / (1 + math.exp(-total))) < 1e-9


def test_paths():
    text = """RandomForestClassificationModel: uid=x, numTrees=1
  Tree 0 (weight 1.0):
    If (feature 0 <= 1.5)
     If (feature 1 <= 2.0E-3)
      Predict: 0.0
     Else (feature 1 > 2.0E-3)
      Predict: 1.0
    Else (feature 0 > 1.5)
     Predict: 1.0
"""
    assert [str(r) for r in quality.paths(text, ("a", "b"))] == ["a <= 1.5", "a <= 1.5 AND b <= 0.002", "a <= 1.5 AND b > 0.002", "a > 1.5"]


def test_an_id_on_many_rows_is_one_row_of_the_sample(spark):
    docs = spark.range(3000).selectExpr("CAST(1 AS LONG) AS doc_id", "concat('text ', lpad(id, 5, '0')) AS text").unionByName(spark.createDataFrame([(4, None), (9, "z")], "doc_id long, text string"))
    labels = spark.createDataFrame([(1, 0), (1, 1), (4, 0), (9, None)], "doc_id long, toxic int")
    got = sorted(map(tuple, training_rows(docs, labels, "toxic").select("doc_id", "text", "label").collect()))
    kept = [r for r in [(1, "text 00000", 1), (4, "", 0)] if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    assert got == kept and kept
