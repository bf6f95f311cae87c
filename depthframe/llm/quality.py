"""Quality classifier: a sparse rule ensemble over text statistics.

1. ``statistics`` reduces every whole text to a few numbers (shares of kinds of characters, repetition, lengths).
2. A small random forest is grown on labelled rows; every path from a root to a node of it is a rule, a conjunction of
   bounds on statistics, such as ``upper <= 0.2 AND doubled > 0.4``.
3. A logistic regression with a lasso penalty weighs the rules; most get no weight.
4. The rules that are left compile to one Spark column expression, which scores all rows inside the scan's stage.

A fitted model is a short list of rules, whatever the data. Fitting takes a bounded sample of labelled rows
(``sampling.SAMPLE_ROWS``), in the order of their ids, so that reruns agree. Scoring has no shuffle.

Defined cases: null text is empty; bytes that are no UTF-8 count as U+FFFD; an empty text has all statistics 0 and gets a score like any other; texts of any
length are reduced whole; without labels, or with one label only, every score is the share of label 1 (0.5 if there are
none); equal rows have equal scores; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_slices, valid_text
from .sampling import SAMPLE_ROWS, held_out, training_rows

STATISTICS = ("chars", "words", "word_length", "upper", "digit", "mark", "pipe", "shout", "symbol", "wide", "line_length", "doubled", "distinct", "commonest", "ended")
THRESHOLD = 0.7
TREES, DEPTH, MIN_ROWS = 16, 3, 5
PENALTY = 0.002
SEED = 42

_KIND = np.zeros((256, 6), bool)  # upper, digit, mark, pipe, shout, symbol
_KIND[65:91, 0] = True
_KIND[48:58, 1] = True
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)], 2] = True
_KIND[ord("|"), 3] = True
_KIND[ord("!"), 4] = True
_KIND[[ord(c) for c in "$%&#*@^~<>{}[]\\"], 5] = True


def _text_statistics(text: str | None) -> tuple[float, ...]:
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return (0.0,) * len(STATISTICS)
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, digit, mark, pipe, shout, symbol = (counts @ _KIND / n).tolist()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    return (
        float(np.log1p(n)),
        float(np.log1p(len(words))),
        sum(map(len, words)) / len(words),
        upper,
        digit,
        mark,
        pipe,
        shout,
        symbol,
        float(counts[128:].sum() / n),
        float(np.log1p(n / len(lines))),
        1 - len(set(lines)) / len(lines),
        len(seen) / len(words),
        max(seen.values()) / len(words),
        sum(x.rstrip()[-1:] in b".!?\"'" for x in lines) / len(lines),
    )


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, "text"):
        others = [c for c in batch.schema.names if c != "text"]
        numbers = np.array([_text_statistics(t) for t in batch["text"].to_pylist()], np.float64).T
        yield pa.RecordBatch.from_arrays([*[batch[c] for c in others], *[pa.array(x) for x in numbers]], names=[*others, *STATISTICS])


def statistics(rows: DataFrame) -> DataFrame:
    """rows with its column text replaced by the statistics."""
    others = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(_reduce, ", ".join([others, *[f"{s} double" for s in STATISTICS]]))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, bound, whether it lies above the bound)."""

    bounds: tuple[tuple[str, float, bool], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, bound, above in self.bounds:
            out = out & ((F.col(name) > bound) if above else (F.col(name) <= bound))
        return out

    def __str__(self) -> str:
        return " AND ".join(f"{n} {'>' if above else '<='} {b:.4g}" for n, b, above in self.bounds)


@dataclass(frozen=True)
class Model:
    rules: tuple[tuple[Rule, float], ...]
    intercept: float

    def column(self) -> Column:
        """The score as an expression over the statistics."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def paths(trees: str, names: tuple[str, ...] = STATISTICS) -> list[Rule]:
    """Every path from a root to another node, from the printed form of Spark's trees; the same path once."""
    found, stack = {}, []
    for line in trees.splitlines():
        m = re.match(r"( *)(If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not m:
            continue
        depth, name, above, bound = len(m[1]), names[int(m[3])], m[4] == ">", float(m[5])
        while stack and stack[-1][0] >= depth:
            stack.pop()
        stack.append((depth, (name, bound, above)))
        tight: dict[tuple[str, bool], float] = {}
        for _, (n, b, up) in stack:
            tight[n, up] = max(tight.get((n, up), b), b) if up else min(tight.get((n, up), b), b)
        found[Rule(tuple((n, b, up) for (n, up), b in sorted(tight.items())))] = None
    return list(found)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = materialize(statistics(training_rows(docs, labels, label, sample_rows)), "quality-sample")
    rows = materialize(rows.repartitionByRange(1, "doc_id").sortWithinPartitions("doc_id", *STATISTICS), "quality-sorted")
    n, ones = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if ones in (0, n):
        share = min(max(ones / n, 1e-6), 1 - 1e-6) if n else 0.5
        return Model((), float(np.log(share / (1 - share))))
    points = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(rows).select("features", F.col("label").cast("double").alias("label"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=MIN_ROWS, seed=SEED, subsamplingRate=0.8).fit(points)
    rules = paths(forest.toDebugString)
    if not rules:
        return Model((), float(np.log(ones / (n - ones))))
    held = rows.select(F.col("label").cast("double").alias("label"), *[r.column().cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    held = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(held).select("features", "label")
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, maxIter=100, standardization=False).fit(held)
    weights = lasso.coefficients.toArray()
    return Model(tuple((r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-9), float(lasso.intercept))


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    model = fit(docs, labels, "quality", sample_rows)
    rows = statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), valid_text("text").alias("text")))
    scored = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs, columns unchanged, that score ``threshold`` or more. Texts pass through, nothing is shuffled."""
    model = fit(docs, labels, "quality", sample_rows)
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), valid_text("text").alias("text"))
    return statistics(named).where(model.column() >= threshold).select("row.*")
