import random
import time

from depthframe.llm.decontamination import Matcher, best_end, drop_contaminated, fold, matches, pattern_bits


def least_distance(pattern, text):
    """Least edit distance of the pattern to any part of text, by the usual table."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (p != c)))
        row = new
        best = min(best, row[-1])
    return best


def edit(rng, text, k, alphabet):
    for _ in range(k):
        i = rng.randrange(len(text))
        text = rng.choice([text[:i] + text[i + 1 :], text[:i] + rng.choice(alphabet) + text[i:], text[:i] + rng.choice(alphabet) + text[i + 1 :]])
    return text


def test_myers():
    rng = random.Random(5)
    for _ in range(150):
        p = "".join(rng.choice("abcé") for _ in range(rng.randint(1, 80)))
        t = "".join(rng.choice("abcé") for _ in range(rng.randint(0, 40))) + edit(rng, p, 3, "abc") + "ab"
        assert best_end(pattern_bits(p), len(p), t, len(p))[0] == least_distance(p, t)


def test_matcher_is_exact():
    rng = random.Random(6)
    alphabet = "abcdefgh ijkl é"
    word = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    items = [word(rng.randint(16, 260)) for _ in range(12)]
    assert Matcher(["x" * n for n in (16, 17, 50, 95, 200)]).budget == [0, 1, 3, 5, 12]
    matcher = Matcher(items)
    for _ in range(80):
        k = rng.randrange(len(items))
        text = word(rng.randint(0, 200)) + edit(rng, items[k], rng.randint(0, matcher.budget[k] + 4), alphabet) + word(rng.randint(0, 200))
        found = {m.item: m for m in matcher.find(text.translate({c: c - 32 for c in range(97, 123)}) if rng.random() < 0.1 else text)}
        for i, item in enumerate(matcher.items):
            d = least_distance(item, fold(text))
            assert (i in found) == (d <= matcher.budget[i])
            if i in found:
                m = found[i]
                assert m.distance == d == least_distance(item, fold(text)[m.start : m.end])


ROWS = [(1, "The quick brown fox jumps over the lazy dog and runs away."), (2, None), (3, ""), (4, "clean text " * 9), (4, "x the quick brown fox jumped over the lazy dog and runs away. y"), (None, "the quick brown fox jumps over the lazy dog and runs away. " * 2)]
ITEMS = [(7, "the quick brown fox jumps over the lazy dog and runs away."), (5, "the quick brown fox jumps over the lazy dog and runs away."), (8, None), (9, ""), (10, "a")]


def test_small(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS row")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted(((r.doc_id or 0), r.item_id, r.distance, r.start, r.places) for r in matches(docs, bench, word_items=16).collect())
    assert got == [(0, 5, 0, 0, 2), (1, 5, 0, 0, 1), (4, 5, 2, 2, 1)]
    assert sorted(r.doc_id for r in drop_contaminated(docs, bench, word_items=16).collect()) == [2, 3, 4]
    assert drop_contaminated(docs, bench).columns == docs.columns
    empty = bench.where("false")
    assert matches(docs, empty).count() == 0 and drop_contaminated(docs, empty).count() == len(ROWS)
    assert matches(docs.where("false"), bench).count() == 0


def test_short_items_are_whole_words(spark):
    docs = spark.createDataFrame([(1, "They said Yes. No more"), (2, "yesterday eyes"), (3, "a c++ book"), (4, "abc++"), (5, "yes yes eyes yes"), (6, "été"), (7, "tété été")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "yes"), (2, "C++"), (3, "  "), (4, "été")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.distance, r.start, r.end, r.places) for r in matches(docs, bench, word_items=16).collect())
    assert got == [(1, 1, 0, 10, 13, 1), (3, 2, 0, 2, 5, 1), (5, 1, 0, 0, 3, 3), (6, 4, 0, 0, 3, 1), (7, 4, 0, 5, 8, 1)]
    assert sorted(r.doc_id for r in drop_contaminated(docs, bench, word_items=16).collect()) == [2, 4]
    assert sorted(r.doc_id for r in drop_contaminated(docs, bench, block_chars=4, word_items=16).collect()) == [2, 4]


def test_short_items_anywhere(spark):
    docs = spark.createDataFrame([(1, "They said Yes. No more"), (2, "yesterday eyes"), (3, "a c++ book"), (4, "abc++"), (5, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "yes"), (2, "C++")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.start, r.places) for r in matches(docs, bench).collect())
    assert got == [(1, 1, 10, 1), (2, 1, 0, 2), (3, 2, 2, 1), (4, 2, 2, 1)]


def test_bytes_that_are_no_text(spark):
    docs = spark.sql("SELECT 1L AS doc_id, CAST(X'FF' || CAST('the quick brown fox jumps over the lazy dog and runs away.' AS BINARY) AS STRING) AS text")
    bench = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    assert [(r.doc_id, r.distance, r.start) for r in matches(docs, bench).collect()] == [(1, 0, 1)]
    assert drop_contaminated(docs, bench).count() == 0


def test_templates_are_exact():
    """Items that share their beginning, middle or end, against the usual table."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefgh ij") for _ in range(n))
    one, two = word(70), word(40)
    items = [f(word(rng.randint(12, 60))) for f in (lambda w: one + w, lambda w: w + one, lambda w: w + one + w[::-1], lambda w: one + w + two) for _ in range(8)]
    items += [one + "same tail " + c for c in "abcdef"]
    matcher = Matcher(items)
    for k in [*range(len(items)), *range(len(items))]:
        text = word(rng.randint(0, 90)) + edit(rng, items[k], rng.randint(0, matcher.budget[k] + 3), "abcdef") + word(rng.randint(0, 90))
        found = {m.item: m for m in matcher.find(text)}
        for i, item in enumerate(matcher.items):
            d = least_distance(item, text)
            assert (i in found) == (d <= matcher.budget[i])
            if i in found:
                assert found[i].distance == d == least_distance(item, text[found[i].start : found[i].end])


def test_templates_cost_little():
    """Four times the items that share a template take less than twelve times as long, and a second at most."""
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    for own in (30, 300):
        template, took = word(100), []
        for n in (500, 2000):
            matcher = Matcher([template + word(own) for _ in range(n)])
            text = word(600) + template + word(600)
            begin = time.process_time()
            assert matcher.find(text) == []
            took.append(time.process_time() - begin)
        assert took[1] < 1 and took[1] < 12 * max(took[0], 0.005)


def test_whole_table_by_plain_search(spark, testdata):
    """Every document against every item with the usual table, on rows that hold a piece of it or don't."""
    docs, bench = (spark.read.parquet(f"{testdata}/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    found = {(r.doc_id, r.item_id): r.distance for r in matches(docs, bench).collect()}
    assert found
    texts = {r.doc_id: fold(r.text or "") for r in docs.collect()}
    items = {r.item_id: fold(r.text) for r in bench.collect()}
    budget = {i: int(0.06 * len(t)) for i, t in items.items()}
    # Documents with a hit against all that share 12 code points with it, by Myers alone.
    for i, item in items.items():
        bits = pattern_bits(item)
        grams = {item[k : k + 8] for k in range(0, len(item) - 7, 4)}
        for d, text in texts.items():
            if (d, i) in found or sum(g in text for g in grams) >= 4:
                distance, _ = best_end(bits, len(item), text, budget[i])
                assert found.get((d, i), budget[i] + 1) == distance


def test_a_very_long_text(spark):
    text = "lorem ipsum dolor " * 40_000 + ITEMS[0][1].replace("lazy", "lzy") + " sit amet" * 1000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = matches(docs, spark.createDataFrame(ITEMS[:1], "item_id long, text string")).collect()
    assert [(r.doc_id, r.distance, r.start) for r in got] == [(1, 1, 720_000)]


def test_blocks_give_the_same(spark, testdata):
    docs, bench = (spark.read.parquet(f"{testdata}/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    one = sorted(map(tuple, matches(docs, bench).collect()))
    assert one == sorted(map(tuple, matches(docs, bench, block_chars=4000).collect()))
    texts = {r.doc_id: r.text for r in docs.collect()}
    exact = {(i, b.item_id) for b in bench.collect() for i, t in texts.items() if b.text in t}
    assert exact <= {(r[0], r[1]) for r in one} and all(r[2] == 0 for r in one if (r[0], r[1]) in exact)
