import random
import re
import zlib
from collections import Counter

import pytest

from depthframe.llm import spelling


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def counted(rows):
    words = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            words[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in words.items() if len(w) >= 5 and n >= 3}


def brute(words):
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {w: (min(near[w], key=lambda x: (-words[x], x)) if near[w] else None) for w in words}
    form = {w: f if f and words[f] >= 2 * words[w] else None for w, f in form.items()}
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n, len(near[w]), form[w], words[form[w]] if form[w] else None, root))
    return sorted(out)


def test_documents(spark):
    rng = random.Random(5)
    stems = ["kitchen", "Garden", "élèves", "ÀBÇDÉ", "banana", "aaaaa", "x" * 70]
    rows = [(rng.randrange(400), " ".join(rng.choice(stems) + rng.choice(["", "", "", "s", "e", "3x"]) for _ in range(rng.randrange(60)))) for _ in range(800)]
    rows += [(None, "kitchens kitchen"), (1, None), (2, ""), (3, "long" * 50_000), (4, "long" * 50_000), (5, "long" * 50_000 + "e"), (9, "×÷ a×bcdefg÷hijkl")] + [(7, "spread spread spreed")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS run", "3 AS n", "4 AS `a.b`")
    words = spelling.word_counts(spelling.damaged(spelling.runs(df)))
    assert {r.word: r.n for r in words.collect()} == counted(rows)
    assert sorted(map(tuple, spelling.group_variants(words).collect())) == brute(counted(rows))
    assert spelling.group_variants(spelling.word_counts(spelling.damaged(spelling.runs(df.where("false"))))).count() == 0


@pytest.mark.parametrize("size, least", [(1 << 16, 64), (1 << 16, 1), (8, 1)])
def test_near_words(spark, monkeypatch, size, least):
    """Whatever the dictionary, all pairs are found; letters are few, so that grams repeat within words."""
    rng = random.Random(least)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(5, 9))) for _ in range(350)}
    words |= {"a" * k for k in range(5, 12)} | {"ab" * 4, "ab" * 4 + "a"}
    df = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    got = spelling.near_words(df, size=size, least=least)
    assert sorted(map(tuple, got.collect())) == sorted((a, b) for a in words for b in words if one_edit(a, b))


def test_dictionary_is_bounded(spark):
    df = spark.createDataFrame([("".join(random.Random(k).choice("abcdefghij") for _ in range(12)),) for k in range(500)], "word string")
    known = spelling.frequent_grams(df, 20, 1)
    assert all(len([g for g in known if len(g) == q]) < 20 for q in (2, 3))
    with pytest.raises(ValueError):
        spelling.near_words(df, length=3)


def test_chain_and_ties(spark):
    words = {"kitchen": 80, "kitchem": 40, "kitchemm": 20, "kitchemmm": 10, "pattern": 6, "patterm": 2, "patterk": 6}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert sorted(map(tuple, spelling.group_variants(df).collect())) == brute(words)
