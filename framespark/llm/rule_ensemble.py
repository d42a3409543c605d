"""Quality classifier: a sparse ensemble of rules over statistics of the text.

A random forest of shallow trees is fitted to labelled documents; every path from a root to a node is a rule, a conjunction of
bounds on statistics. A logistic regression with a lasso penalty weighs the rules and drops most of them. The rest is compiled
into one Spark column expression, so scoring a document needs no model object: only its statistics, measured in one pass over
the whole text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from framespark.llm.common import Words, slices, stash, text_bytes, work_dir
from framespark.llm.quality import measure_slice

#: Bound on the labelled rows that the model is fitted to.
MAX_EXAMPLES = 20_000
TREES, DEPTH, SEED = 20, 3, 12
#: Weight of the lasso penalty against the mean log-loss.
PENALTY = 0.001
#: A document counts as good from this score.
THRESHOLD = 0.3

STATISTICS = (
    "n_words", "word_length", "longest_word", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "distinct_ratio", "top_word_ratio",
    "upper_ratio", "digit_ratio", "punctuation_ratio", "exclamation_ratio", "end_ratio", "line_words", "wide_ratio",
)


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


#: Classes of bytes that are counted per document; the last one is the first bytes of characters beyond ASCII.
UPPER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
DIGIT = _class("0123456789")
PUNCTUATION = _class("".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()))
CLASSES = (UPPER, DIGIT, PUNCTUATION, _class("!"), _class(".!?"), _class("\n"), np.arange(256) >= 0xC0)


def statistics_slice(col: pa.Array) -> list[np.ndarray]:
    """The STATISTICS of each text; ratios to nothing are 0."""
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words = measure_slice(col)
    data, off = text_bytes(col)
    w = Words(data, off)
    n = len(off) - 1
    part = lambda a, b: a / np.maximum(b, 1)
    tally = lambda of: np.diff(np.concatenate(([0], np.cumsum(of[data])))[off])
    upper, digit, punctuation, exclamation, end, line, wide = (tally(c) for c in CLASSES)

    longest, distinct, top = np.zeros(n), np.zeros(n), np.zeros(n)
    if len(w.start):
        np.maximum.at(longest, w.doc, w.end - w.start)
        # occurrences of each distinct word of a document
        order = np.lexsort((w.hash, w.doc))
        h, d = w.hash[order], w.doc[order]
        new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1]))))
        times = np.diff(np.append(new, len(h)))
        distinct = np.bincount(d[new], minlength=n)
        np.maximum.at(top, d[new], times)
    values = [
        n_words, part(word_chars, n_words), longest, part(n_symbols, word_chars), part(n_dup_lines, line + 1), part(n_repeat_words, n_words), part(distinct, n_words), part(top, n_words),
        part(upper, word_chars), part(digit, word_chars), part(punctuation, word_chars), part(exclamation, n_words), part(end, n_words), part(n_words, line + 1), part(wide, word_chars),
    ]
    return [np.asarray(v, np.float64) for v in values]


def statistics(docs: DataFrame, keep: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """The columns keep and one double for each of STATISTICS per row of docs; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            cols = [pa.array(c) for c in statistics_slice(b.column(text))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *cols], names=[*keep, *STATISTICS])

    return docs.select(*keep, text).mapInArrow(run, StructType([*(docs.schema[c] for c in keep), *(StructField(s, DoubleType()) for s in STATISTICS)]))


# ---------------------------------------------------------------- rules


@dataclass(frozen=True, order=True)
class Rule:
    """Bounds (statistic, over or null, up to or null), at most one pair a statistic."""

    bounds: tuple[tuple[str, float | None, float | None], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, over, upto in self.bounds:
            if over is not None:
                out = out & (F.col(name) > over)
            if upto is not None:
                out = out & (F.col(name) <= upto)
        return out

    def __str__(self) -> str:
        return " and ".join((f"{o:.4g} < " if o is not None else "") + s + (f" <= {u:.4g}" if u is not None else "") for s, o, u in self.bounds)


@dataclass(frozen=True)
class RuleModel:
    """Score = logistic(intercept + weights of the rules that hold)."""

    intercept: float
    weights: tuple[tuple[Rule, float], ...] = ()

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.weights:
            total = total + F.when(rule.column(), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def _paths(node, bounds: dict) -> Iterator[Rule]:
    """A rule for each node below this one of a fitted tree."""
    if bounds:
        yield Rule(tuple((s, *bounds[s]) for s in sorted(bounds)))
    if node.subtreeDepth() == 0:
        return
    name, at = STATISTICS[node.split().featureIndex()], node.split().threshold()
    over, upto = bounds.get(name, (None, None))
    yield from _paths(node.leftChild(), bounds | {name: (over, at if upto is None else min(upto, at))})
    yield from _paths(node.rightChild(), bounds | {name: (at if over is None else max(over, at), upto)})


def fit(docs: DataFrame, labels: DataFrame, folder: str | None = None) -> RuleModel:
    """A model from labels(doc_id, quality 0 or 1) and docs(doc_id, text), of which at most MAX_EXAMPLES rows are used, picked by a hash.

    A doc_id with several labels counts as bad if any is; other values, nulls and labels without a document are ignored, and
    rows that repeat a doc_id count each. With labels of one kind the score is that label for all; without any it is 0.
    The examples are written to the shared folder and, being bounded, put in one partition in a fixed order, so that the forest's random
    draws and the sums are the same in every rerun.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("double").alias("label"))
    picked = known.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(MAX_EXAMPLES)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # MAX_EXAMPLES narrow rows
    folder = folder or work_dir(docs.sparkSession)
    rows = statistics(rows, ("doc_id", "label")).orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id", *STATISTICS).limit(MAX_EXAMPLES)
    rows = stash(rows.coalesce(1), folder, "examples")
    share = rows.agg(F.avg("label")).head()[0]
    if share in (None, 0.0, 1.0):
        return RuleModel(-math.inf if not share else math.inf)

    x = rows.select("label", array_to_vector(F.array(*STATISTICS)).alias("features"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, maxBins=128, minInstancesPerNode=5, subsamplingRate=0.5, featureSubsetStrategy="onethird", seed=SEED).fit(x)
    rules = sorted({r for t in forest.trees for r in _paths(t._java_obj.rootNode(), {})}, key=str)
    if not rules:
        return RuleModel(math.log(share / (1 - share)))
    held = stash(rows.select("label", F.array(*[r.column().cast("double") for r in rules]).alias("held")), folder, "held")
    y = held.select("label", array_to_vector("held").alias("features"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, maxIter=100, tol=1e-5).fit(y)
    return RuleModel(float(lasso.intercept), tuple((r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray(), strict=True) if w))


def classify(docs: DataFrame, model: RuleModel, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) per row of docs(doc_id, text), from the text alone.

    Null and empty texts have statistics of 0 and the score that the rules give those; repeated rows score alike and a null doc_id stays.
    Other columns are ignored.
    """
    score = model.score().alias("score")
    return statistics(docs, ("doc_id",)).select("doc_id", score).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: doc_id, held_out, score, predicted; the model learns from the rows that are not held out."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels.where(~held_out()))
    return classify(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
