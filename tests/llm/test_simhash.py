import random

import numpy as np
import pytest
import xxhash

from depthframe.llm.components import connected_components
from depthframe.llm.simhash import hexadecimal, keep_one, links, near_duplicates


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(prints, distance=2):
    """doc position -> smallest position reachable, by comparing all."""
    p = np.array(prints, np.uint64)
    parent = list(range(len(p)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(p)):
        for j in np.flatnonzero(np.bitwise_count(p[i + 1 :] ^ p[i]) <= distance) + i + 1:
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(p))]


def test_whole_table(spark, testdata):
    docs = spark.read.parquet(f"{testdata}/sf0.01/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    prints = [plain_fingerprint(t) for _, t in rows]
    want = {rows[i][0]: (f"{prints[i]:016x}", rows[g][0]) for i, g in enumerate(groups(prints))}
    from pyspark.sql import functions as F

    got = near_duplicates(docs).withColumn("h", hexadecimal(F.col("fingerprint"))).collect()
    assert {r.doc_id: (r.h, r.component_id) for r in got} == want and len(got) == len(rows)


def check_links(spark, prints):
    """Links are near enough and connect what a comparison of all connects."""
    prints = sorted(prints)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    found = links(spark.createDataFrame([(signed(p),) for p in prints], "fingerprint long")).collect()
    plain = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in found]
    assert all((a ^ b).bit_count() <= 2 for a, b in plain)
    assert len(plain) <= 65 * len(prints)
    at = {p: i for i, p in enumerate(prints)}
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in plain:
        x, y = root(at[a]), root(at[b])
        parent[max(x, y)] = min(x, y)
    assert [root(i) for i in range(len(prints))] == groups(prints)


def test_links_connect_all_near_ones(spark):
    rng = random.Random(2)
    prints = {0, (1 << 64) - 1, 1 << 63}
    for b in [rng.getrandbits(64) for _ in range(40)]:
        for _ in range(6):
            prints.add(b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))))
    check_links(spark, prints)


@pytest.mark.parametrize("shift", [0, 32])
def test_links_of_a_shared_half(spark, shift):
    """5,000 fingerprints share one half: no pairs are made of them."""
    rng = random.Random(shift)
    half, others = rng.getrandbits(32) << (32 - shift), set()
    while len(others) < 5_000:
        x = rng.getrandbits(32)
        others |= {x, x ^ 1 << rng.randrange(32), x ^ 3 << rng.randrange(31)}
    check_links(spark, {half | x << shift for x in others})


def test_edge_rows(spark):
    rows = [(5, None), (3, ""), (9, "one"), (9, "One"), (None, "two words"), (2, "three short words"), (1, "é " * 9), (1, "é " * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fingerprint", "2 AS component_id")
    got = near_duplicates(df).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.fingerprint & (1 << 64) - 1) for r in got) == sorted(((i is None, i or 0), plain_fingerprint(t)) for i, t in rows)
    assert {r.doc_id: r.component_id for r in got} == {5: 3, 3: 3, 9: 9, None: None, 2: 2, 1: 1}
    assert near_duplicates(df.where("false")).count() == 0
    kept = keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 9]


def test_keep_one_tells_groups_of_equal_ids_apart(spark):
    rows = [(None, "one two three four"), (None, "quite other words here"), (7, "five six seven eight"), (7, "unlike in every word"), (7, "unlike in every word")]
    kept = keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=str) == sorted(set(rows), key=str)


def test_components_of_a_long_path(spark):
    n = 300
    df = spark.range(n - 1).selectExpr("id * 7 % 1009 AS a", "(id + 1) * 7 % 1009 AS b")
    got = connected_components(df).collect()
    assert len(got) == n and len({r.component for r in got}) == 1
    assert connected_components(df.where("false")).count() == 0
