"""Groups of spelling variants: words one edit apart, found through an index of variable-length grams.

Words are maximal letter runs. Two of them are *near* if one inserted, deleted or replaced code point makes them equal; a word's
*form* is its most frequent near word, if that is frequent enough. Method:

1. Gram dictionary. Words are framed by a start and an end mark. Grams of ``SHORTEST`` letters that words hold more often than a
   threshold are prolonged, letter by letter, up to ``LONGEST``; all other grams are selective and are left as they are. So
   the dictionary to be known is the frequent grams; the threshold leaves ``DICTIONARY`` of each length at most.
2. Decomposition. At each place of a word stands the shortest gram that the dictionary doesn't prolong.
3. Bound. An edit at a letter changes just the grams that cover it, for each word counted exactly. With the worst place
   leaving B of a word's g distinct grams unharmed, two near words share at least max(B, B') grams. Framed words of
   ``LONGEST`` letters or more always have B >= 1.
4. Merging. So they share one of the g - B + 1 rarest of either. Only the lists of those are read, each list split by word
   length and place, where an edit moves a gram by one at most; what meets is verified by edit distance.

How it scales. Each text is cut into runs where it lies; runs are counted with partial sums, so a word that a third of all texts
hold is a row a task. The rest works on distinct words: a few dozen short rows each. The dictionary goes to the tasks
with the function, its size bounded by DICTIONARY. Lists of rarest grams at one place and length are joined as plain rows,
which Spark can split; verified pairs are as many as the near pairs themselves. Forms are followed to the last by pointer
doubling: a form is several times as frequent as its word, so chains are short and have no cycle.

Defined cases: null texts have no words; a null doc_id counts as an empty one; a run of any length is one word; equal rows
count twice; ties of frequency go to the smallest in code-point order; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Maximal letter runs, of which only A to Z are lower-cased.
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Shortest word, in code points, and least number of its occurrences.
LENGTH, COUNT = 5, 3
#: A form is at least so many times as frequent as its word.
RATIO = 2
#: A run loses a letter where this divides its hash.
DAMAGE = 97
#: Code points of a gram, frame included.
SHORTEST, LONGEST = 2, 4
#: Grams of one length that may be prolonged, at most; and how often a gram occurs at least for that.
DICTIONARY, FREQUENT = 1 << 16, 64
#: The frame, which is no letter.
START, END = "^", "$"


def runs(docs: DataFrame) -> DataFrame:
    """doc_id, run (lower-cased) of every letter run of every text."""
    found = docs.select("doc_id", F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(RUN), F.lit(0))).alias("run"))
    ascii_only = F.octet_length("run") == F.length("run")
    return found.select("doc_id", F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER)).alias("run"))


def damaged(found: DataFrame, every: int = DAMAGE) -> DataFrame:
    """word: each run, without one of its letters where ``every`` divides the CRC-32 h of "doc_id:run" (place h % length)."""
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
    rows = found.select("run", F.crc32(named.cast("binary")).alias("h"))
    place = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))
    return rows.select(F.when(F.col("h") % every == 0, short).otherwise(F.col("run")).alias("word"))


def word_counts(words: DataFrame, length: int = LENGTH, count: int = COUNT) -> DataFrame:
    """word, n of the words that are long and frequent enough."""
    return words.where(F.length("word") >= length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= count)


def frequent_grams(words: DataFrame, size: int = DICTIONARY, least: int = FREQUENT) -> set[str]:
    """The grams that are prolonged, at most ``size`` of each length: those that occur more often than the threshold.

    Of a length, a gram's prefix must be frequent itself. The threshold of a length is its number of occurrences by ``size``,
    or ``least`` if that is more, so fewer than ``size`` grams can exceed it.
    """
    framed = F.concat(F.lit(START), "word", F.lit(END))
    known: set[str] = set()
    for q in range(SHORTEST, LONGEST):
        places = F.sequence(F.lit(1), F.length("framed") - (q - 1))
        grams = words.select(framed.alias("framed")).where(F.length("framed") >= q).select(F.explode(F.transform(places, lambda p, q=q: F.substring("framed", p, F.lit(q)))).alias("gram"))
        counts = materialize(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "spelling-grams")
        threshold = max(least, -(-(counts.agg(F.sum("n")).first()[0] or 0) // size))
        known |= {r.gram for r in counts.where(F.col("n") > threshold).collect() if q == SHORTEST or r.gram[:-1] in known}
    return known


def decompose(word: str, known: set[str]) -> tuple[list[tuple[str, int]], int]:
    """The (gram, place) pairs of a framed word, and how many of its distinct grams any one edit leaves unharmed."""
    framed = f"{START}{word}{END}"
    n, grams = len(framed), []
    for p in range(n - SHORTEST + 1):
        end = p + SHORTEST
        while end - p < LONGEST and end < n and framed[p:end] in known:
            end += 1
        grams.append(framed[p:end])
    places: dict[str, int] = {}
    for g in grams:
        places[g] = places.get(g, 0) + 1
    worst = 0
    for i in range(1, n - 1):
        hit: dict[str, int] = {}
        for p in range(max(0, i - LONGEST + 1), min(i, len(grams) - 1) + 1):
            if p + len(grams[p]) > i:
                hit[grams[p]] = hit.get(grams[p], 0) + 1
        worst = max(worst, sum(places[g] == k for g, k in hit.items()))
    return [(g, p) for p, g in enumerate(grams)], len(places) - worst


def _decomposed(known: set[str]):
    schema = pa.schema([("word", pa.string()), ("gram", pa.string()), ("place", pa.int32()), ("read", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for word in batch["word"].to_pylist():
                grams, left = decompose(word, known)
                read = len({g for g, _ in grams}) - left + 1
                rows += [(word, g, p, read) for g, p in grams]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return run


def near_words(words: DataFrame, length: int = LENGTH, size: int = DICTIONARY, least: int = FREQUENT) -> DataFrame:
    """(word, near): all pairs of words (as from ``word_counts``) that are one edit apart, both ways."""
    if length < LONGEST:
        raise ValueError(f"words under {LONGEST} letters may share no gram with a near word")
    known = frequent_grams(words, size, least)
    grams = materialize(words.select("word").mapInArrow(_decomposed(known), "word string, gram string, place int, read int"), "spelling-index")
    lists = grams.select("word", "gram").distinct().groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    each = grams.join(lists, "gram").groupBy("word", "gram", "n", "read").agg(F.collect_list("place").alias("places"))
    by_rarity = F.sort_array(F.collect_list(F.struct("n", "gram", "places")))
    rarest = each.groupBy("word", "read").agg(by_rarity.alias("grams")).select("word", F.explode(F.expr("slice(grams, 1, read)")).alias("g"))
    index = materialize(rarest.select("word", F.length("word").alias("length"), F.col("g.gram").alias("gram"), F.explode("g.places").alias("place")), "spelling-lists")

    # A word meets those as long as itself, once, and those that are a letter longer, whose grams may stand a place further.
    spots = F.array(*[F.struct((F.col("length") + longer).alias("length"), (F.col("place") + moved).alias("place")) for longer, moved in ((0, 0), (1, 0), (1, 1))])
    asked = index.select("word", "gram", F.explode(spots).alias("at")).select("word", "gram", "at.*")
    other = index.withColumnRenamed("word", "near")
    met = asked.join(other, ["gram", "length", "place"]).where("word < near OR length(word) < length(near)")
    pairs = materialize(met.where(F.levenshtein("word", "near", 1) == 1).select("word", "near").distinct(), "spelling-pairs")
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("word").alias("near")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): from each word of (word, form) along the forms to the last, by pointer doubling."""
    at = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = materialize(at.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        at = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return at


def group_variants(words: DataFrame, length: int = LENGTH, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of (word, n)."""
    words = materialize(words.select("word", "n"), "spelling-words")
    near = near_words(words, length).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near"))).alias("best"))
    known = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.order") >= ratio * F.col("n"), F.col("best")).alias("best"))
    known = materialize(known.select("word", "n", "n_near", F.col("best.near").alias("form"), (-F.col("best.order")).alias("form_n")), "spelling-forms")
    last = roots(known.where("form IS NOT NULL"))
    return known.join(last, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
