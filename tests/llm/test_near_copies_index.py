"""The SimHash index of near copies: signatures against plain counts, deletion variants against all pairs, and recall at the similarity."""

import itertools

import numpy as np

from depthframe.llm.common import mix64
from depthframe.llm.near_copies import CHECK, SIMILARITY, VOTES, check_limit, neighbours, segment_bits, segment_count, segments, signature


def test_signature_is_the_majority():
    rng = np.random.default_rng(3)
    for n, words in ((1, 2), (2, 3), (47, 5), (900, 40)):
        hashes = rng.integers(0, 1 << 63, n).astype(np.uint64)
        stream = mix64(np.arange(1, words * VOTES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        votes = mix64(hashes[:, None] ^ stream).reshape(-1, words).tolist()
        for at, word in enumerate(signature(hashes, words).tolist()):
            assert word == sum(1 << b for b in range(64) if 2 * sum(v[at] >> b & 1 for v in votes) > len(votes))


def test_segments_get_longer_with_the_table():
    assert [segment_bits(n) for n in (0, 1, 1 << 18, (1 << 18) + 1, 1 << 20, (1 << 20) + 1)] == [24, 24, 24, 26, 26, 28]
    assert segment_count(24) < segment_count(26) < segment_count(28)


def test_pairs_at_the_similarity_share_a_variant():
    rng = np.random.default_rng(4)
    bits, count = 24, segment_count(24)
    for union, only in ((5, (1, 0)), (10, (1, 1)), (50, (5, 5)), (300, (60, 0)), (400, (40, 40))):
        for _ in range(40):
            x = rng.integers(0, 1 << 63, union).astype(np.uint64)
            a, b = (signature(s, CHECK + -(-bits * count // 64)) for s in (x[only[0] :], x[: union - only[1]]))
            assert sum((int(p) ^ int(q)).bit_count() for p, q in zip(a[:CHECK], b[:CHECK], strict=True)) <= check_limit(SIMILARITY)
            x, y = (segments(s[CHECK:], bits, count).tolist() for s in (a, b))
            assert any((p ^ q).bit_count() <= 1 for p, q in zip(x, y, strict=True))


def test_variants_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    for bits in (8, 24):
        base = (rng.integers(0, 3, 300) << bits) | rng.integers(0, 1 << bits, 300)
        values = sorted({int(v) for v in base} | {int(v) ^ (1 << int(k)) for v, k in zip(base, rng.integers(0, bits, 300), strict=True)})
        want = {(a, b) for a, b in itertools.combinations(values, 2) if a >> bits == b >> bits and (a ^ b).bit_count() == 1}
        got = neighbours(spark.createDataFrame([(v, -v) for v in values], "value long, holder long"), bits).collect()
        assert len(got) == len(want) >= 300 - 30
        assert {tuple(sorted((r.a, r.b))) for r in got} == want and all((r.u, r.v) == (-r.a, -r.b) for r in got)
