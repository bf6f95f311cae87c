import hashlib
from collections import defaultdict

from depthframe.llm.mixing import IDENTITY, keyed, mix


def brute(rows):
    size = {k: len((t or "").encode().split()) for k, (_, t, _) in enumerate(rows)}
    by = defaultdict(list)
    for k, (_, _, s) in enumerate(rows):
        by[(s is None, s or "")].append(k)
    names = sorted(by, key=lambda x: (x[0], x[1].encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total = {s: sum(size[k] for k in by[s]) for s in names}
    left, target, open_ = 1.5 * sum(total.values()), {}, set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * total[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 2.0 * total[s]
            left -= target[s]
        open_ -= full
    return size, by, total, target


def check(df, rows):
    got = df.collect()
    size, by, total, target = brute(rows)
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        s = (r.source is None, r.source or "")
        assert r.source_size == total[s] and abs(r.target - target[s]) < 1e-6 * max(1, target[s])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[s] += r.taken
    for s in by:
        assert abs(taken[s] - target[s]) < 1
    assert sorted(r["size"] for r in got) == sorted(size.values())
    return got


def test_small(spark):
    rows = [(1, "a b c", "x"), (2, "d", "y"), (3, None, "y"), (4, "", None), (5, "e f", None), (5, "e f", None), (None, "g h", "é"), (6, "k\x0bl\tm\x85n", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS key", "3 AS taken")
    check(mix(df), rows)
    assert mix(df.where("false")).count() == 0


def test_hot_source_and_rerun(spark):
    rows = [(i, "w " * (1 + int(hashlib.md5(str(i).encode()).hexdigest()[:2], 16)), "hot" if i % 3 else f"s{i % 5}") for i in range(9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = check(mix(df), rows)
    again = mix(df.repartition(7)).collect()
    assert sorted(first) == sorted(again)


def test_ids_of_many_rows(spark):
    """Null ids, an id of many texts and many copies of one row: the mix is right, reruns agree, keys are spread."""
    rows = [(None, f"w{i} " * (i % 7), "a") for i in range(2000)] + [(1, f"v{i}", "a") for i in range(2000)] + [(2, "same row", "b")] * 2000 + [(i, "x y", "a") for i in range(10, 2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = check(mix(df), rows)
    assert sorted(map(str, first)) == sorted(map(str, mix(df.repartition(5)).collect()))
    sized = df.selectExpr("doc_id", "0 AS no_source", "source AS source_name", "1L AS size", "xxhash64(text) AS tie")
    with_keys = keyed(sized, "").collect()
    assert sorted(str([r[c] for c in IDENTITY]) for r in with_keys) == sorted(str(list(r)) for r in sized.collect())
    # 286 of the texts of null ids are empty: copies of one row, told apart by their numbers.
    assert len({r.key for r in with_keys}) == len(rows)
