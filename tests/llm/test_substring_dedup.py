import hashlib

import pytest

from depthframe.llm.substring_dedup import substring_dedup


def brute(rows, window=20):
    rows = sorted(rows)
    seen, out = set(), {}
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    for doc, words in texts:
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            key = b" ".join(words[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[doc] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def found(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()}


def test_small_cases(spark):
    w = [f"w{i}" for i in range(200)]
    rows = [
        (1, " ".join(w[:60])),
        (2, " ".join(["x", *w[10:50], "y"])),
        (3, " ".join(w[:60])),
        (4, "\t".join(w[30:49])),
        (5, None),
        (6, ""),
        (7, " ".join(["a"] * 100)),
        (8, " ".join(w[100:130] + w[100:130])),
        (9, "é ü " * 50),
        (10, "\x0b".join(w[30:50])),
        (11, " ".join(w[30:49])),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnsRenamed({}).selectExpr("*", "1 AS n_words", "2 AS copy")
    assert found(substring_dedup(df)) == brute(rows)


def test_same_id_and_empty_table(spark):
    t = " ".join(f"q{i}" for i in range(40))
    df = spark.createDataFrame([(1, t), (1, t)], "doc_id long, text string")
    assert sorted(r.n_removed for r in substring_dedup(df).collect()) == [0, 40]
    assert substring_dedup(df.where("false")).count() == 0


def test_words_that_a_polynomial_modulo_a_power_of_two_confuses(spark):
    """Complementary Thue-Morse words: equal under any base modulo 2**64."""
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    lead = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{lead} {word}"), (2, f"{lead} {other}"), (3, f"x {lead} {word}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(substring_dedup(df)) == brute(rows)


def test_a_very_long_text_and_many_copies(spark):
    long = " ".join(f"v{i % 997}" for i in range(60_000))
    rows = [(1, long), (2, "z " + long), *[(10 + k, " ".join(f"c{i}" for i in range(30))) for k in range(300)]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(substring_dedup(df)) == brute(rows)


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_whole_table(spark, testdata, sf):
    docs = spark.read.parquet(f"{testdata}/{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found(substring_dedup(docs)) == brute(rows)
