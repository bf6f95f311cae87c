import zlib

from depthframe.llm.sharding import assign, write_shards


def brute(rows, n):
    """(doc_id, size, crc, shard, slot), where ids and texts decide the order."""
    data = [((t or "").encode(), d) for d, t in rows]
    data.sort(key=lambda x: (x[1] is not None, x[1] or 0, zlib.crc32(x[0]), len(x[0])))
    total, at, out, slots = sum(len(t) + 1 for t, _ in data), 0, [], {}
    for t, d in data:
        size = len(t) + 1
        shard = (2 * at + size) * n // (2 * total)
        out.append((d, size, zlib.crc32(t), shard, slots.setdefault(shard, 0)))
        slots[shard] += 1
        at += size
    return sorted(out, key=str)


def check(df, rows, n=8):
    got = sorted((tuple(r) for r in assign(df, n).collect()), key=str)
    assert got == brute(rows, n)
    return got


def test_small(spark):
    rows = [(1, "abc"), (2, None), (3, ""), (3, "é" * 9), (3, "é" * 9), (None, "x"), (None, None), (-5, "z" * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS part", "2 AS nth", "3 AS size", "4 AS `a.b`")
    for n in (1, 2, 8):
        check(df, rows, n)
    assert assign(df.where("false")).count() == 0


def test_balance(spark):
    rows = [(i, "w" * (i * 7919 % 300)) for i in range(3000)] + [(7, "copy " * 20)] * 2000 + [(3001, "l" * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(13)
    got = check(df, rows)
    held = [sum(r[1] for r in got if r[3] == k) for k in range(8)]
    assert max(held) - min(held) < 50_001 + 300
    small = [r for r in rows if r[0] != 3001]
    held = [sum(r[1] for r in check(df.where("doc_id <> 3001"), small) if r[3] == k) for k in range(8)]
    assert max(held) - min(held) <= 302


def test_long_text_and_more_shards_than_rows(spark):
    rows = [(1, "x" * 2_000_000), (2, "y")]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_written(spark, tmp_path):
    rows = [(i % 50, f"{i}", i) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, slot int").withColumnRenamed("slot", "a.b")
    write_shards(df, f"{tmp_path}/out", 4)
    back = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(tuple(r.row) for r in back) == sorted(rows)
    for k in range(4):
        mine = [(r.slot, r.row.doc_id) for r in back if r.shard == k]
        assert sorted(s for s, _ in mine) == list(range(len(mine)))
        assert [d for _, d in sorted(mine)] == sorted(d for _, d in mine)
