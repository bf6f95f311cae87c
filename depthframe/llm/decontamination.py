"""Benchmark decontamination: pigeonhole edit matching.

A test item may appear in a document with up to ``k`` edits (insertions, deletions, substitutions of code points),
``k`` being ``ERROR_RATE`` of its length. The item is cut into ``k + 1`` pieces; wherever it appears, at least one piece is
unchanged. All pieces of all items are searched for in one pass over each text (an Aho-Corasick automaton), and each
place that a hit points to is verified with Myers' bit-parallel edit distance. Only ASCII letters are folded.

Items that share a template. Any cut into ``k + 1`` pieces is exact, so cuts are made where each piece holds some
``GRAM`` code points that few items have; then a template alone hits nothing. An item that is mostly template is cut
evenly, and the many items that a hit points to at one place go through one walk along their common beginnings (or
ends), with the text as Myers' pattern, which leaves a branch once it is over every budget below it; what it leaves over
is verified one by one.

How it scales. Documents are scanned where they lie, without a shuffle, and matches leave the scan. Items go to the tasks
in blocks of about ``BLOCK_CHARS`` code points. A larger benchmark is searched block by block: each block's result is
written before the next block is read, so the driver and the tasks hold one block at a time, whatever the benchmark's
size; documents are scanned once for each block. A worker builds a block's automaton once for all its tasks. Items with
equal text are searched once.

Defined cases: null and empty texts hold nothing; bytes that are no UTF-8 count as U+FFFD; null items and items of white
space alone are skipped; items of fewer than ``1 / ERROR_RATE`` code points are searched without errors, wherever they
stand; with ``word_items``, items under so many code points count only as whole words (no letter or digit of any
script beside them), as they turn up within words by chance; items that share their text count as that of the smallest item_id (null last);
a document with an item in several places gives one row, its best place (fewest errors, then leftmost), with the number of
places; repeated rows give repeated matches; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_slices, valid_text

ERROR_RATE = 0.06
BLOCK_CHARS = 4_000_000
#: Code points that tell a piece's items from others, and the number of items that may have them in common.
GRAM, FEW = 8, 3
#: Items at about one place (within ``NEARBY`` code points) that are walked together rather than one by one.
TOGETHER, NEARBY = 4, 256


def fold(text: str) -> str:
    return text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}


def _whole(text: str, start: int, end: int) -> bool:
    """Whether the part of text isn't cut out of a word."""
    return not (text[start].isalnum() and text[start - 1 : start].isalnum()) and not (text[end - 1].isalnum() and text[end : end + 1].isalnum())


@dataclass(frozen=True)
class Match:
    item: int
    distance: int
    start: int
    end: int
    places: int


def best_end(pattern_bits: dict[str, int], m: int, text: str, bound: int) -> tuple[int, int]:
    """Least edit distance of the pattern to any part of text, and where the leftmost such part ends (Myers)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score, best, end = full, 0, m, bound + 1, -1
    for j, c in enumerate(text):
        x = pattern_bits.get(c, 0) | vn
        d0 = ((vp + (x & vp)) ^ vp) | x
        hn = vp & d0
        hp = vn | (full & ~(vp | d0))
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp = (hp << 1) & full
        vn = hp & d0
        vp = ((hn << 1) & full) | (full & ~(hp | d0))
        if score < best:
            best, end = score, j + 1
    return best, end


def pattern_bits(text: str) -> dict[str, int]:
    bits: dict[str, int] = defaultdict(int)
    for i, c in enumerate(text):
        bits[c] |= 1 << i
    return dict(bits)


def telling(items: list[str]) -> list[np.ndarray]:
    """For each item, the places whose next ``GRAM`` code points occur at most ``FEW`` times in all items."""
    points = np.frombuffer("".join(items).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    grams = np.zeros(max(0, len(points) - GRAM + 1), np.uint64)
    for k in range(GRAM):
        grams = (grams ^ points[k : k + len(grams)]) * np.uint64(0x9E3779B97F4A7C15)
        grams ^= grams >> np.uint64(29)
    _, which, counts = np.unique(grams, return_inverse=True, return_counts=True)
    few = counts[which] <= FEW
    ends = np.cumsum([len(t) for t in items])
    return [np.flatnonzero(few[end - len(t) : max(end - GRAM + 1, end - len(t))]) for t, end in zip(items, ends.tolist(), strict=True)]


def cuts(length: int, pieces: int, told: np.ndarray) -> list[int]:
    """Ends of the pieces, 0 first: each piece has a telling place if there are enough of them, or else they are equally long."""
    ends, at = [], 0
    while (k := int(np.searchsorted(told, at))) < len(told):
        at = int(told[k]) + GRAM
        ends.append(at)
    if len(ends) < pieces:
        return [length * p // pieces for p in range(pieces + 1)]
    return [0, *(ends[len(ends) * p // pieces - 1] for p in range(1, pieces)), length]


def common_start(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    return low


def may_occur(items: list[tuple[str, int]], window: str) -> list[bool]:
    """Whether each of the sorted items (text, budget) has a distance to a part of window within the largest budget."""
    budget, size = max(b for _, b in items), len(window)
    full, bits = (1 << size) - 1, pattern_bits(window)

    def least(vp: int, vn: int, depth: int) -> int:
        """Smallest of the column of distances, which starts with depth and goes up and down by the bits."""
        up, down = (np.unpackbits(np.frombuffer(v.to_bytes(size // 8 + 1, "little"), np.uint8), bitorder="little").astype(np.int32) for v in (vp, vn))
        return depth + min(0, int(np.cumsum(up - down).min()))

    out, column, over, last = [], [(0, 0)], False, ""
    for item, _ in items:
        same = common_start(last, item)
        last = item
        if over and same >= len(column) - 1:
            out.append(False)
            continue
        del column[same + 1 :]
        vp, vn = column[-1]
        over = False
        for depth in range(same + 1, len(item) + 1):
            x = bits.get(item[depth - 1], 0) | vn
            d0 = (((x & vp) + vp) ^ vp) | x
            hn = vp & d0
            hp = ((vn | (full & ~(vp | d0))) << 1) | 1
            vn = hp & d0 & full
            vp = ((hn << 1) | ~(hp | d0)) & full
            column.append((vp, vn))
            if (depth % 8 == 0 or depth == len(item)) and depth > budget and least(vp, vn, depth) > budget:
                over = True
                break
        out.append(not over)
    return out


class Matcher:
    """Finds items, given as texts, in texts. Items under ``word_items`` code points count as whole words only."""

    def __init__(self, items: list[str], error_rate: float = ERROR_RATE, word_items: int = 0):
        import ahocorasick

        self.items, self.word_items = [fold(t) for t in items], word_items
        self.budget, places = [], defaultdict(list)
        for k, (item, told) in enumerate(zip(self.items, telling(self.items), strict=True)):
            budget = 0 if len(item) < word_items else int(error_rate * len(item))
            self.budget.append(budget)
            at = cuts(len(item), budget + 1, told)
            for a, b in zip(at, at[1:], strict=False):
                places[item[a:b]].append((k, b))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, where)
        self.automaton.make_automaton()
        self.bits: dict[int, tuple[dict[str, int], dict[str, int]]] = {}

    def find(self, text: str | None) -> list[Match]:
        if not text or not self.items:
            return []
        text = fold(text)
        starts = defaultdict(set)
        for last, where in self.automaton.iter(text):
            for k, after in where:
                starts[k].add(last + 1 - after)
        places, unsure = defaultdict(list), []
        for k, found in starts.items():
            item, budget = self.items[k], self.budget[k]
            if not budget:
                exact = [x for x in found if x >= 0 and text.startswith(item, x)]
                words = len(item) < self.word_items
                places[k] += [(0, x, x + len(item)) for x in exact if not words or _whole(text, x, x + len(item))]
                continue
            for a, b in self._runs(sorted(found), budget):
                if a == b and a >= 0 and text.startswith(item, a):
                    places[k].append((0, a, a + len(item)))
                else:
                    unsure.append((a, b, k))
        for a, b, k in self._likely(text, sorted(unsure)):
            item, budget = self.items[k], self.budget[k]
            low = max(0, a - budget)
            window = text[low : b + len(item) + budget]
            ahead, behind = self._bits(k)
            distance, end = best_end(ahead, len(item), window, budget)
            if distance <= budget:
                _, back = best_end(behind, len(item), window[:end][::-1], distance)
                places[k].append((distance, low + end - back, low + end))
        return [Match(k, *min(at), len(at)) for k, at in sorted(places.items()) if at]

    def _likely(self, text: str, runs: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
        """The runs (first, last, item) without those that a walk with their neighbours rules out."""
        at = 0
        while at < len(runs):
            end = at
            while end < len(runs) and runs[end][0] - runs[at][0] <= NEARBY and runs[end][1] - runs[at][0] <= 2 * NEARBY:
                end += 1
            end = max(end, at + 1)
            group, at = runs[at:end], end
            if len(group) < TOGETHER:
                yield from group
                continue
            budget = max(self.budget[k] for _, _, k in group)
            window = text[max(0, group[0][0] - budget) : max(b + len(self.items[k]) for _, b, k in group) + budget]
            if not window:
                continue
            ahead = {k: self.items[k] for _, _, k in group}
            behind = {k: t[::-1] for k, t in ahead.items()}
            orders = [(sorted(d, key=d.__getitem__), d) for d in (ahead, behind)]
            shared = [sum(common_start(d[x], d[y]) for x, y in zip(o, o[1:], strict=False)) for o, d in orders]
            order, texts = orders[shared[1] > shared[0]]
            ok = may_occur([(texts[k], self.budget[k]) for k in order], window[::-1] if texts is behind else window)
            kept = {k for k, x in zip(order, ok, strict=True) if x}
            yield from (run for run in group if run[2] in kept)

    def _bits(self, k: int) -> tuple[dict[str, int], dict[str, int]]:
        if k not in self.bits:
            self.bits[k] = pattern_bits(self.items[k]), pattern_bits(self.items[k][::-1])
        return self.bits[k]

    @staticmethod
    def _runs(starts: list[int], budget: int) -> Iterator[tuple[int, int]]:
        """Implied starts that lie within twice the budget of each other, as (first, last)."""
        first = last = starts[0]
        for s in starts[1:]:
            if s - last > 2 * budget:
                yield first, last
                first = s
            last = s
        yield first, last


@lru_cache(maxsize=1)
def _matcher(items: tuple[str, ...], error_rate: float, word_items: int) -> Matcher:
    """A worker's matcher of the block at hand, kept from task to task."""
    return Matcher(list(items), error_rate, word_items)


def distinct_items(benchmark: DataFrame) -> DataFrame:
    """(text, item_id): each item's text once, with the smallest of its ids."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), valid_text("text").alias("text"))
    return items.where(F.col("text").rlike(r"\S")).groupBy("text").agg(F.min("item_id").alias("item_id"))


def n_blocks(items: DataFrame, block_chars: int) -> int:
    return -(-items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] // block_chars)


def read_block(items: DataFrame, blocks: int, block: int) -> list[tuple[int | None, str]]:
    """The items of one block of about the same size as the others: (item_id, text)."""
    if blocks > 1:
        items = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block)
    return sorted(((r.item_id, r.text) for r in items.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def matches(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS, word_items: int = 0) -> DataFrame:
    """doc_id, item_id, distance, start, end (code points of the best place), places: one row per document and item."""
    schema = "doc_id long, item_id long, distance int, start long, end long, places int"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), valid_text("text").alias("text"))
    items = distinct_items(benchmark)
    blocks = n_blocks(items, block_chars)
    out = rows.sparkSession.createDataFrame([], schema)
    for block in range(blocks):
        wanted = read_block(items, blocks, block)

        def run(batches: Iterator[pa.RecordBatch], wanted=wanted) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(tuple(t for _, t in wanted), error_rate, word_items)
            for batch in text_slices(batches, "text"):
                found = [(i, wanted[m.item][0], m.distance, m.start, m.end, m.places) for i, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True) for m in matcher.find(t)]
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
                names = ["doc_id", "item_id", "distance", "start", "end", "places"]
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate(types)], names=names)

        found = rows.mapInArrow(run, schema)
        out = out.unionByName(materialize(found, "matches") if blocks > 1 else found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS, word_items: int = 0) -> DataFrame:
    """The rows of docs that hold no test item, columns unchanged. Rows pass through the scan, nothing is shuffled."""
    columns = docs.columns
    items = distinct_items(benchmark)
    blocks = n_blocks(items, block_chars)
    out = docs
    for block in range(blocks):
        wanted = [t for _, t in read_block(items, blocks, block)]

        def run(batches: Iterator[pa.RecordBatch], wanted=wanted) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(tuple(wanted), error_rate, word_items)
            for batch in text_slices(batches, "text"):
                clean = [not matcher.find(t) for t in batch["text"].to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_())).select(["row"])

        named = out.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), valid_text("text").alias("text"))
        out = named.mapInArrow(run, named.select("row").schema).select("row.*")
        if blocks > 1:
            out = materialize(out, "clean")
    return out
