"""Near copies against a comparison of all pairs of shingle sets."""

import itertools
import random

from pyspark.sql import functions as F

import corpus_pipeline as cp
from depthframe.llm.near_copies import keep_one


def shingle_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def similar(a, b):
    both = len(a & b)
    return a == b or 5 * both >= 4 * (len(a) + len(b) - both) and both > 0


def roots(sets, pairs):
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in pairs:
        a, b = root(i), root(j)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(sets))]


def common(sets):
    """Pairs of positions that share a shingle, or are both empty, and are similar."""
    at = {}
    for i, s in enumerate(sets):
        for x in s or [None]:
            at.setdefault(x, []).append(i)
    near = {p for v in at.values() if len(v) > 1 for p in itertools.combinations(v, 2)}
    return {p for p in near if similar(sets[p[0]], sets[p[1]])}


def test_recall_on_a_table(spark, testdata):
    docs = spark.read.parquet(f"{testdata}/sf0.01/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    sets = [shingle_set(t) for _, t in rows]
    want = sorted(rows[i][0] for i, g in enumerate(roots(sets, common(sets))) if g == i)
    assert sorted(r.doc_id for r in cp.near_copies_stage(spark, docs, f"{testdata}/sf0.01").collect()) == want


def test_edited_copies_of_large_groups(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    texts = []
    for size in (60, 25, 1, 1):
        base = [word() for _ in range(200)]
        texts.append(" ".join(base))
        for _ in range(size - 1):
            edited = list(base)
            for k in rng.sample(range(200), rng.randint(1, 5)):
                edited[k] = word()
            texts.append(" ".join(edited))
    # Chains: each text is close to the one before, the ends are far apart; and texts with half of their shingles in common.
    base = [word() for _ in range(150)]
    for _ in range(40):
        base = list(base)
        base[rng.randrange(150)] = word()
        texts.append(" ".join(base))
        texts.append(" ".join(base[:75] + [word() for _ in range(60)]))
    # Cuts and repeats of one text, so that little of a text is its own.
    for _ in range(40):
        a, b = sorted(rng.sample(range(150), 2))
        texts.append(" ".join(base[: a] + base[b:] + base[a : a + rng.randint(0, 30)]))
    sets = [shingle_set(t) for t in texts]
    want = [i for i, g in enumerate(roots(sets, common(sets))) if g == i]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for hot in (4, 1000):
        assert sorted(r.doc_id for r in keep_one(df, hot=hot).collect()) == want
    assert keep_one(df.where("false")).count() == 0


def test_edge_rows(spark):
    rows = [(5, None), (3, ""), (9, "one"), (9, "One"), (None, "two words"), (None, "quite other words"), (2, "three short words"), (2, "unlike text"), (1, "é " * 9), (1, "é " * 9)]
    got = keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), (r.text or "").lower()) for r in got) == sorted([("3", ""), ("9", "one"), ("None", "two words"), ("None", "quite other words"), ("2", "three short words"), ("2", "unlike text"), ("1", "é " * 9)])


def test_keep_one_with_clashing_columns(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(3, text, 1), (1, text + " end", 2), (2, "other", 3), (None, None, 4), (None, "", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    plain = sorted((r.n, r.doc_id) for r in keep_one(df).collect())
    for name in ("a.b", "row", "__row", "__at", "__set", "node", "lead", "size", "`"):
        df = df.withColumn(name, F.lit(7))
    got = keep_one(df)
    assert got.columns == df.columns
    assert sorted((r[2], r[0]) for r in got.collect()) == plain and {n for n, _ in plain} >= {2, 3} and len(plain) == 3
