import hashlib
import random

from depthframe.llm.fingerprints import PrefixHash, likeness, with_next


M = (1 << 64) - 1


def mixed(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M
    return x ^ x >> 31


def polynomial(codes, k):
    prime, base = ((2147483647, 911382323), (2147483629, 972663749))[k]
    return sum((c + 1) * pow(base, i, prime) for i, c in enumerate(codes)) % prime


def plain_fingerprint(text):
    """The fingerprint from its definition, span by span."""
    codes = [ord(c) for c in text]
    bins = {}
    for s in range(len(codes) - 11):
        h = mixed(polynomial(codes[s : s + 12], 0))
        bins[h >> 59] = min(bins.get(h >> 59, M), h)
    grid = [g for g in sorted({1} | {k << e for e in range(12) for k in (2, 3)}) if g <= len(codes)]
    steps = [mixed(polynomial(codes[:g], 0) << 31 | polynomial(codes[:g], 1)) & 0xFFFF for g in grid]
    values = [bins[b] & 0xFFFF | 1 if b in bins else 0 for b in range(32)] + steps
    return f"{polynomial(codes, 0) | polynomial(codes, 1) << 31:016x}{len(codes):08x}" + "".join(f"{v:04x}" for v in values)


def plain_likeness(a, b):
    if a == b:
        return 1.0
    x, y = ([int(p[k : k + 4], 16) for k in range(24, len(p), 4)] for p in (a, b))
    used = [(u, v) for u, v in zip(x[:32], y[:32], strict=True) if u or v]
    bins = sum(u == v for u, v in used) / len(used) if used else 0.0
    grid = sorted({1} | {k << e for e in range(40) for k in (2, 3)})
    k = 0
    while k < min(len(x), len(y)) - 32 and x[32 + k] == y[32 + k]:
        k += 1
    return max(bins, min(1.0, grid[k - 1] / max(int(a[16:24], 16), int(b[16:24], 16)) if k else 0.0))


def test_fingerprint_and_likeness_from_their_definitions():
    rng = random.Random(8)
    texts = ["", "a", "é𝒳", "same same", "x" * 500]
    for n in (11, 12, 13, 200, 700):
        t = "".join(rng.choice("abc é𝒳\n") for _ in range(n))
        texts += [t, t[: n // 2] + "zz" + t[n // 2 :]]
    prints = [plain_fingerprint(t) for t in texts]
    assert [PrefixHash(t).fingerprint() for t in texts] == prints
    for a in prints:
        for b in prints:
            assert likeness(a, b) == plain_likeness(a, b)


def brute(rows):
    rows = sorted(rows)
    out = {}
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(t)
        edited = t[: n - n // 2] + after[: n // 2]
        out[i] = (n, hashlib.sha256(edited.encode()).hexdigest(), PrefixHash(t).fingerprint(), PrefixHash(edited).fingerprint(), t == edited, t == after)
    return out


def check(df, rows):
    got = with_next(df).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        n, sha, a, b, same, as_next = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (n, sha, a, b)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert not same or r.near_edited == 1
        assert not as_next or r.near_next == 1
        assert r.common_prefix >= n - n // 2
    return got


def test_spans_and_extensions():
    rng = random.Random(3)
    a = "".join(rng.choice("abé𝒳") for _ in range(300))
    b = a[:120] + "z" + a[100:]
    x, y = PrefixHash(a), PrefixHash(b)
    for _ in range(300):
        i, j, n = rng.randrange(300), rng.randrange(300), rng.randrange(40)
        assert (x.span(i, min(300, i + n)) == y.span(j, min(len(b), j + n))) == (a[i : i + n] == b[j : j + n])
        k = 0
        while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
            k += 1
        assert x.extension(i, y, j) == k
    assert x.common_prefix(y) >= 120 and x.common_suffix(y) >= 200


def test_likeness_orders_texts():
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(2, 3000))) for _ in range(60)]
    prints = [PrefixHash(t).fingerprint() for t in texts]
    for k, t in enumerate(texts):
        near = PrefixHash(t[: -(len(t) // 3) or None] + "?").fingerprint()
        assert likeness(prints[k], prints[k]) == 1
        assert likeness(prints[k], near) > 0.3 > max(likeness(prints[k], p) for j, p in enumerate(prints) if j != k and len(texts[j]) > 20) or len(t) < 20


def test_small(spark):
    rows = [(4, None), (1, "a"), (2, "éé"), (9, "x" * 70_000), (3, "𝒳 long enough to have spans"), (7, ""), (8, "𝒳 long enough to have spans")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS tie", "2 AS part")
    check(df, rows)
    assert with_next(df.where("false")).count() == 0
    one = with_next(df.where("doc_id = 3")).collect()
    assert len(one) == 1 and one[0].near_next == 1
    twice = with_next(df.where("doc_id = 3").union(df.where("doc_id = 3"))).collect()
    assert len(twice) == 2 and {r.near_next for r in twice} == {1.0}


def test_small_rows_from_their_definitions(spark):
    rng = random.Random(12)
    rows = [(k, "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 90)))) for k in range(30)]
    got = {r.doc_id: r for r in with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, t in rows:
        after, n = rows[(k + 1) % len(rows)][1], len(t)
        edited = t[: n - n // 2] + after[: n // 2]
        own, new, other = map(plain_fingerprint, (t, edited, after))
        r = got[k]
        assert (r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) == (own, new, plain_likeness(own, new), plain_likeness(own, other))
        assert r.common_prefix == next((i for i, (x, y) in enumerate(zip(t, edited, strict=True)) if x != y), n)


def test_whole_table(spark, testdata):
    df = spark.read.parquet(f"{testdata}/sf0.01/documents.parquet")
    got = check(df.repartition(5), [(r.doc_id, r.text) for r in df.collect()])
    assert sum(r.near_edited > r.near_next for r in got) > 0.95 * len(got)
