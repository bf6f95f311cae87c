import random

from pyspark.sql import functions as F

from depthframe.operators import book, time_travel
from depthframe.plans import fixture


def test_cover(spark):
    """Blocks are disjoint, make up the interval, and are two of a size at most."""
    rng = random.Random(1)
    pairs = [tuple(sorted((rng.randrange(1 << 12), rng.randrange(1 << 12)))) for _ in range(300)] + [(0, 1 << 12), (0, 0), (5, 6), (1, (1 << 12) - 1)]
    rows = spark.createDataFrame(pairs, "a long, b long").withColumn("cover", time_travel.dyadic_cover(F.col("a"), F.col("b"), 12)).collect()
    for r in rows:
        covered = [x for level, block in r.cover for x in range(block << level, (block + 1) << level)]
        assert sorted(covered) == list(range(r.a, r.b))
        assert all(sum(level == k for level, _ in r.cover) <= 2 for k in range(13))


def test_books_as_of(spark):
    rng, rows = random.Random(4), []
    start = 1_800_000_000_000_000  # receipts in microseconds
    for price in range(1, 9):
        for venue in (1, 2):
            at = start + rng.randrange(50)
            while at < start + 4000:
                end = at + rng.randrange(1, 700)
                rows.append((1 + price % 2, venue, "BID", price, rng.randrange(1, 99), at, end if rng.random() < 0.95 else None))
                at = end + rng.randrange(3) * 40 if rows[-1][-1] else start + 9999
    intervals = spark.createDataFrame(rows, "book int, venue int, side string, price_raw long, size_raw long, from_seq long, to_seq long")
    points = [(b, start + x) for b in (1, 2, 3) for x in (*range(0, 4300, 17), 60, 60)] + [(1, start - 5), (None, start), (1, None)]
    got = time_travel.books_as_of(intervals, spark.createDataFrame(points, "book int, seq long"))
    wanted = {}
    for b, seq in set(points):
        for book_, _, side, price, size, a, z in rows:
            if book_ == b and seq is not None and a <= seq and (z is None or z > seq):
                wanted[b, seq, side, price] = wanted.get((b, seq, side, price), 0) + size
    assert {tuple(r)[:4]: r.size_raw for r in got.collect()} == wanted
    single = time_travel.books_as_of(intervals, spark.createDataFrame([(1, start + 60)], "book int, seq long")).drop("seq")
    assert sorted(map(tuple, single.collect())) == sorted(map(tuple, book.book_as_of(intervals.where("book = 1"), start + 60).collect()))
    assert time_travel.books_as_of(intervals, spark.createDataFrame([], "book int, seq long")).count() == 0


def test_keyframes(spark, testdata, tmp_path):
    diffs = book.l2_diffs(fixture.levels(spark, f"{testdata}/sf0.001").where("seq < 800")).cache()
    time_travel.write_keyframes(diffs, str(tmp_path / "frames"), 16)
    frames = spark.read.parquet(str(tmp_path / "frames"))
    one = time_travel.book_from_keyframes(frames, 2, 50, 16)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, book.book_at_revision(diffs.where("book = 2"), 50).drop("book").collect()))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(book" in plan and "(block" in plan.split("PartitionFilters")[1].split("]")[0]
    assert len(one.inputFiles()) > 0 and frames.where("book = 2 AND block = 3").select(F.input_file_name()).distinct().count() == 1
    revisions = spark.createDataFrame([(b, r) for b in range(4) for r in (1, 16, 17, 33, 48, 90, 90)], "book int, book_seq long")
    got = sorted(map(tuple, time_travel.books_from_keyframes(frames, revisions, 16).collect()))
    wanted = []
    for b, r in revisions.distinct().collect():
        wanted += [(b, r, x.side, x.price_raw, x.size_raw) for x in book.book_at_revision(diffs.where(f"book = {b}"), r).collect()]
    assert got == sorted(wanted)


def test_a_revision_costs_its_book(spark, tmp_path, capsys):
    """Every revision of a long folder, by a plain walk; nothing is aggregated over all rows before it."""
    diffs = [(1, n, n, "BID", 1 + n % 3, n % 5) for n in range(1, 601)]
    df = spark.createDataFrame(diffs, "book int, seq long, book_seq long, side string, price_raw long, size_raw long")
    time_travel.write_keyframes(df, str(tmp_path / "frames"), 256)
    at = df.select("book", "book_seq")
    found = time_travel.books_from_keyframes(spark.read.parquet(str(tmp_path / "frames")), at, 256)
    held, want = {}, []
    for _, _, n, side, price, size in diffs:
        held[side, price] = size
        want += [(1, n, *k, z) for k, z in held.items() if z]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    found.explain()
    assert "max_by" not in capsys.readouterr().out


def test_books_as_of_by_any_blocks_of_points(spark):
    """A point sees the changes of its own message and of none after it, whatever the blocks; long runs meet a block once."""
    rng = random.Random(6)
    held = [(b, v, "BID", p, rng.randint(1, 9), s, s + rng.choice((1, 3, 300_000))) for b in (1, 2) for v in (1, 2) for p in (5, 6) for s in (10, 400_000, 800_000)] + [(1, 3, "ASK", 9, 4, 2, None)]
    points = [(b, rng.choice((rng.randint(0, 20), rng.randint(0, 1_200_000), 10, 13, 400_000))) for b in (1, 2, 3) for _ in range(60)]
    wanted = {}
    for b, q in set(points):
        for book_, _, side, price, size, start, end in held:
            if book_ == b and start <= q and (end is None or q < end):
                wanted[b, q, side, price] = wanted.get((b, q, side, price), 0) + size
    intervals = spark.createDataFrame(held, "book int, venue int, side string, price_raw long, size_raw long, from_seq long, to_seq long")
    asked = spark.createDataFrame(points, "book int, seq long")
    for k in (1, 7, 1000):
        got = time_travel.books_as_of(intervals, asked, k).select("book", "seq", "side", "price_raw", "size_raw").collect()
        assert sorted(map(tuple, got)) == sorted((*key, size) for key, size in wanted.items())
