import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from depthframe.llm import prefix_trie
from depthframe.llm.list_ranking import NONE, ranks

SCHEMA = "conv_id long, turn long, role string, text string"


def ordered(rows):
    said = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            said[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    return {c: [x[3:] for x in sorted(v)] for c, v in said.items()}


def rebuilt(said):
    out = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = abs(c) // 20 * 20 * (1 if c >= 0 else -1)
        out[c] = said.get(base, [])[:h] + own[h:]
    return out


def brute(said):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in said.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    leaves, saved, kids = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            kids[path[:-1]] += 1
    for path, m in members.items():
        words = len(path[-1][1].encode().split()) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in kids
            saved[path[:d]] += (len(m) - 1) * words
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], digest(ends[p])) for p, m in members.items())


def made(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        c = c - 30
        shared = rng.choice([0, 1, 2, 5])
        for t in range(rng.choice([0, 1, 2, 4, 7, 9])):
            text = f"said {t} by all" if t < shared else rng.choice(["a b", "", None, f"x {c}", "é ü"])
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "user", None]) if t % 2 == 0 else "assistant", text))
    return rows


@pytest.mark.parametrize("base, width, depths", [(1 << 14, 1 << 16, 4096), (5, 7, 3)])
def test_trie(spark, monkeypatch, base, width, depths):
    monkeypatch.setattr(prefix_trie, "DEPTHS", depths)
    rows = made(1, 120) + [(500, t, "user", f"turn {t} of one") for t in range(150)] + [(None, 1, "user", "x")]
    rows += [(1000 + k, 0, "user", "copied") for k in range(200)] + [(4, 0, "user", "again")] * 3
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS part", "2 AS nth", "3 AS depth", "4 AS `a.b`").repartition(5)
    ids = df.select("conv_id")
    shown = lambda x: sorted(map(tuple, x.collect()))
    assert shown(prefix_trie.trie(prefix_trie.positions(df), ids, base, width)) == brute(ordered(rows))
    heads = prefix_trie.with_shared_heads(prefix_trie.positions(df))
    assert shown(prefix_trie.trie(heads, ids, base, width)) == brute(rebuilt(ordered(rows)))


def test_turnless_and_empty(spark):
    rows = [(21, 0, "user", "one"), (22, 0, "user", "one"), (23, 5, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = prefix_trie.trie(prefix_trie.positions(df), spark.createDataFrame([(21,), (22,), (23,), (9,)], "conv_id long"))
    assert sorted(map(tuple, got.collect())) == brute(ordered(rows) | {9: []})
    assert prefix_trie.prefix_trie(df.where("false")).count() == 0


def test_long_text(spark):
    rows = [(1, 0, "user", "w " * 1_000_000), (2, 0, "user", "w " * 1_000_000), (2, 1, "assistant", "y")]
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, got.collect())) == brute(ordered(rows))


def test_ranks(spark):
    order = list(range(3000))
    random.Random(3).shuffle(order)
    links = [(x, order[k - 1] if k else NONE, order[k + 1] if k + 1 < len(order) else NONE) for k, x in enumerate(order)]
    got = ranks(spark.createDataFrame(links, "element long, pred long, succ long"), base=20)
    assert sorted((r["rank"], r.element) for r in got.collect()) == list(enumerate(order))
