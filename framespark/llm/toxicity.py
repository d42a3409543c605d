"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes.

Terms are lower-case words and the first five characters of longer ones; every term of the examples is in the vocabulary.
A weight is (1 + log tf) * idf, with document frequencies of all documents, times 1 + the term's log-likelihood ratio
between the toxic examples and the others: a factor that lets telling terms prevail and drops none. The examples are a
bounded sample of labelled rows. Their vectors are postings by term, cut in blocks of examples, with the greatest weight
of a term in each block; the most frequent terms are kept as dense rows and added up by a matrix product. Both bound the
cosine of any example of a block. A query scores the blocks of the highest bounds, then every block that could still reach
its k-th best, so neighbours are exact; all that are as near as the k-th count, whatever their order. Votes weigh by
distance; a logistic curve calibrates them, fitted to votes on the examples with each one's label taken back, out of the
index and out of its own term weights. The nearest examples are returned as evidence.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framespark.llm.common import Words, ragged, slices, stash, text_bytes, work_dir

#: Bound on the labelled rows that are examples.
MAX_EXAMPLES = 4096
NEIGHBOURS = 15
#: Examples of a block, blocks scored at first, frequent terms kept dense, and queries of a matrix product.
BLOCK, FIRST_BLOCKS, DENSE, QUERIES = 512, 2, 512, 256
#: Cosines that differ by less are equal.
SAME = 1e-9
#: A vote weighs 1 / (distance + SOFT); PRIOR is the weight of the base rate among the votes.
SOFT, PRIOR = 0.1, 1.0
PREFIXES = (5,)

#: Bytes that part terms: ASCII other than letters.
PARTS = np.ones(256, bool)
PARTS[128:] = False
PARTS[list(range(65, 91)) + list(range(97, 123))] = False


def terms(col: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """(document row, term hash) of every occurrence of a term, and the number of documents."""
    low = pa.array([x.lower() if x else "" for x in col.to_pylist()], pa.large_string())
    data, off = text_bytes(low)
    w = Words(data, off, PARTS)
    docs, hashes = [w.doc], [w.hash]
    for k in PREFIXES:
        at, h = w.prefixes(k)
        docs.append(w.doc[at])
        hashes.append(h)
    return np.concatenate(docs), np.concatenate(hashes), len(off) - 1


def log_likelihood_ratio(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Of terms in a of n1 and b of n0 documents."""

    def part(k: np.ndarray, n: int, p: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(k > 0, k * np.log(p), 0) + np.where(n - k > 0, (n - k) * np.log(1 - p), 0)

    both = (a + b) / max(n1 + n0, 1)
    return 2 * (part(a, n1, a / max(n1, 1)) + part(b, n0, b / max(n0, 1)) - part(a, n1, both) - part(b, n0, both))


def term_counts(col: pa.Array, vocabulary: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first entry of each document, terms, occurrences): hashes in order, or numbers of those in a sorted vocabulary."""
    doc, h, n = terms(col)
    if vocabulary is not None:
        v = len(vocabulary)
        at = np.minimum(np.searchsorted(vocabulary, h), max(v - 1, 0))
        hit = vocabulary[at] == h if v else np.zeros(len(h), bool)
        key, tf = np.unique(doc[hit] * v + at[hit], return_counts=True)
        return np.searchsorted(key, np.arange(n + 1) * v), key % max(v, 1), tf
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return np.searchsorted(doc[at], np.arange(n + 1)), h[at], np.diff(np.append(at, len(h)))


class Weights:
    """Unit vectors over a sorted vocabulary: n1, n0 toxic and other examples, a and b of them with each term."""

    def __init__(self, vocabulary: np.ndarray, idf: np.ndarray, a: np.ndarray, b: np.ndarray, n1: int, n0: int):
        self.vocabulary, self.idf, self.a, self.b, self.n1, self.n0 = vocabulary, idf.astype(np.float32), a.astype(np.int16), b.astype(np.int16), n1, n0
        self.factor = (1 + np.maximum(log_likelihood_ratio(a, b, n1, n0), 0)).astype(np.float32)

    def unit(self, first: np.ndarray, term: np.ndarray, tf: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """Weights of the entries; own is the label of each document, taken out of its factors."""
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        factor = self.factor[term]
        if own is not None:
            for label in (0, 1):
                at = np.flatnonzero(own[doc] == label)
                t = term[at]
                lone = log_likelihood_ratio(self.a[t] - label, self.b[t] - (1 - label), self.n1 - label, self.n0 - (1 - label))
                factor[at] = 1 + np.maximum(lone, 0)
        weight = (1 + np.log(tf)) * self.idf[term].astype(np.float64) * factor
        norm = np.sqrt(np.bincount(doc, weights=weight**2, minlength=len(first) - 1))
        return weight / np.maximum(norm[doc], 1e-300)


class BlockMaxIndex:
    """Unit vectors of the examples, in single precision to be small on the wire: dense rows of the most frequent terms; of the others postings by term, in blocks of
    examples, with the greatest weight of each block."""

    def __init__(self, first: np.ndarray, term: np.ndarray, weight: np.ndarray, label: np.ndarray, name: np.ndarray, v: int):
        self.base_rate = float(label.mean()) if len(label) else 0.0
        # examples with the same strongest term stand together, which makes the bounds tight
        some = np.flatnonzero(np.diff(first))
        strongest = np.array([term[a:b][np.argmax(weight[a:b])] for a, b in zip(first[some], first[some + 1], strict=True)], np.int64)
        order = some[np.lexsort((name[some], strongest))]
        self.label, self.name = label[order].astype(np.float64), name[order]
        place = np.full(len(first) - 1, -1)
        place[order] = np.arange(len(order))
        row = place[np.repeat(np.arange(len(first) - 1), np.diff(first))]
        self.blocks = -(-len(order) // BLOCK)
        df = np.bincount(term, minlength=v)
        frequent = np.argsort(-df, kind="stable")[:DENSE]
        self.dense_at = np.full(v, -1, np.int16)
        self.dense_at[frequent] = np.arange(len(frequent))
        at = self.dense_at[term]
        self.dense = np.zeros((len(frequent), self.blocks * BLOCK), np.float32)
        self.dense[at[at >= 0], row[at >= 0]] = weight[at >= 0]
        rare = np.flatnonzero(at < 0)
        rare = rare[np.lexsort((row[rare], term[rare]))]
        t, self.row, self.weight = term[rare], row[rare].astype(np.int32), weight[rare].astype(np.float32)
        key = t * self.blocks + self.row // BLOCK
        cell = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        self.cell_first = np.append(cell, len(key)).astype(np.int32)
        self.cell_block = (self.row[cell] // BLOCK).astype(np.int16)
        self.cell_top = np.maximum.reduceat(self.weight, cell) if len(cell) else np.zeros(0, np.float32)
        self.cells = np.searchsorted(t[cell], np.arange(v + 1)).astype(np.int32)

    def nearest(self, first: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int, without: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(examples, cosines) of each query: the k nearest with a cosine above 0 and all as near as the last of them, nearest
        first. ``without`` names an example for each query that doesn't count."""
        at = self.dense_at[term]
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        for low in range(0, len(first) - 1, QUERIES):
            high = min(low + QUERIES, len(first) - 1)
            part = np.flatnonzero(at[first[low] : first[high]] >= 0) + first[low]
            frequent = np.zeros((high - low, len(self.dense)))
            frequent[doc[part] - low, at[part]] = weight[part]
            sums = frequent @ self.dense
            tops = sums.reshape(high - low, self.blocks, BLOCK).max(axis=2)
            for i in range(low, high):
                rare = np.flatnonzero(at[first[i] : first[i + 1]] < 0) + first[i]
                yield self._nearest(sums[i - low], tops[i - low], term[rare], weight[rare], k, None if without is None else without[i])

    def _nearest(self, score: np.ndarray, top: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int, without: int | None) -> tuple[np.ndarray, np.ndarray]:
        count = self.cells[term + 1] - self.cells[term]
        cell = ragged(self.cells[term], count)
        w = np.repeat(weight, count)
        block = self.cell_block[cell]
        bound = top + np.bincount(block, weights=w * self.cell_top[cell], minlength=self.blocks)
        out = np.flatnonzero(self.name == without) if without is not None else None
        done = np.zeros(self.blocks, bool)
        last = 0.0
        for stage in (0, 1):
            if stage == 0:
                todo = np.zeros(self.blocks, bool)
                todo[np.argpartition(-bound, FIRST_BLOCKS - 1)[:FIRST_BLOCKS] if self.blocks > FIRST_BLOCKS else slice(None)] = True
            else:
                todo = ~done & (bound >= last - SAME)
            mine = todo[block]
            if mine.any():
                c = cell[mine]
                many = self.cell_first[c + 1] - self.cell_first[c]
                hit = ragged(self.cell_first[c], many)
                score += np.bincount(self.row[hit], weights=np.repeat(w[mine], many) * self.weight[hit], minlength=len(score))
            done |= todo
            here = np.flatnonzero(np.repeat(done, BLOCK)[: len(self.name)])
            here = here[score[here] > SAME]
            if out is not None:
                here = here[~np.isin(here, out)]
            cos = score[here]
            if len(cos) > k:
                last = -np.partition(-cos, k - 1)[k - 1]
                near = cos >= last - SAME
                here, cos = here[near], cos[near]
            else:
                last = 0.0
        order = np.argsort(-np.round(cos, 9), kind="stable")
        return here[order], np.minimum(cos[order], 1.0)

    def vote(self, ids: np.ndarray, cos: np.ndarray) -> float:
        # equal cosines may differ in their last bits, and so might sums over them in another order
        w = np.round(1 / (1 - np.round(cos, 9) + SOFT), 9)
        return float((math.fsum(w * self.label[ids]) + PRIOR * self.base_rate) / (math.fsum(w) + PRIOR))


def fit_curve(raw: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve of log-odds of votes, by Newton steps with a weak pull to slope 1."""
    x = np.log(np.clip(raw, 1e-4, 1 - 1e-4) / (1 - np.clip(raw, 1e-4, 1 - 1e-4)))
    beta = np.array([1.0, 0.0])
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (p - label) + 0.1 * (beta - [1.0, 0.0])
        hess = (design * (p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta = beta - np.clip(step, -2, 2)
        if abs(step).max() < 1e-9:
            break
    return max(float(beta[0]), 0.0), float(beta[1])


class Core:
    """What tasks need: weights and index."""

    def __init__(self, weights: Weights, index: BlockMaxIndex):
        self.weights, self.index = weights, index

    def raw(self, col: pa.Array, own: np.ndarray | None = None, without: np.ndarray | None = None) -> tuple[list[float], list[list[int]]]:
        """Votes and evidence; for calibration with each text's own label and example left out."""
        first, term, tf = term_counts(col, self.weights.vocabulary)
        votes, evidence = [], []
        for ids, cos in self.index.nearest(first, term, self.weights.unit(first, term, tf, own), NEIGHBOURS, without):
            votes.append(self.index.vote(ids, cos))
            evidence.append(self.index.name[ids[:3]].tolist())
        return votes, evidence


class Model:
    """A core, sent to the executors once, and the curve of its votes."""

    def __init__(self, core: Broadcast, slope: float, shift: float):
        self.core, self.slope, self.shift = core, slope, shift


def calibrated(raw: float, slope: float, shift: float) -> float:
    raw = min(max(raw, 1e-4), 1 - 1e-4)
    return 1 / (1 + math.exp(-(slope * math.log(raw / (1 - raw)) + shift)))


def document_frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """(documents with each term, documents), counted over all of docs; each task sends one sum a term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        n = np.zeros(len(v) + 1, np.int64)  # the last one counts the documents
        for b in slices(batches):
            _, term, _ = term_counts(b.column("text"), v)
            n[:-1] += np.bincount(term, minlength=len(v))
            n[-1] += b.num_rows
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["term", "n"])

    got = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(vocabulary) + 1, np.int64)
    df[got["term"].to_numpy()] = got["n"].to_numpy()
    return df[:-1], int(df[-1])


def fit(docs: DataFrame, labels: DataFrame, folder: str | None = None) -> Model | None:
    """A model from labelled rows (doc_id, toxic 0 or 1), of which at most MAX_EXAMPLES are used; None if one label lacks.

    A doc_id with several labels counts as toxic if any is; labels without a document, and other values, are ignored.
    Which rows are sampled depends on a hash. What reaches the driver is the terms of at most MAX_EXAMPLES texts.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    picked = known.orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id").limit(MAX_EXAMPLES)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").selectExpr("cast(doc_id as long) doc_id", "text", "toxic")
    rows = stash(rows, folder or work_dir(spark), "examples")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            first, h, tf = term_counts(b.column("text"))
            lists = [pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(x)) for x in (h.view(np.int64), tf.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), *lists], names=["doc_id", "toxic", "h", "tf"])

    got = rows.mapInArrow(count, "doc_id long, toxic int, h array<long>, tf array<int>").orderBy("doc_id").toArrow().combine_chunks()
    label = got["toxic"].to_numpy().astype(np.int64)
    n1 = int(label.sum())
    n0 = len(label) - n1
    if not n1 or not n0:
        return None
    first = np.concatenate(([0], np.cumsum([len(x) for x in got["h"]]))).astype(np.int64)
    h, tf = (got[c].combine_chunks().flatten().to_numpy() for c in ("h", "tf"))
    vocabulary, term = np.unique(h.view(np.uint64), return_inverse=True)
    toxic = np.repeat(label, np.diff(first)) == 1
    v = len(vocabulary)
    a, b = np.bincount(term[toxic], minlength=v), np.bincount(term[~toxic], minlength=v)
    del h
    df, n = document_frequencies(docs, vocabulary)
    weights = Weights(vocabulary, np.log((n + 1) / (df + 0.5)), a, b, n1, n0)
    index = BlockMaxIndex(first, term, weights.unit(first, term, tf), label, got["doc_id"].to_numpy(), v)
    shared = spark.sparkContext.broadcast(Core(weights, index))

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            raw, _ = shared.value.raw(b.column("text"), b.column("toxic").to_numpy(), b.column("doc_id").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(raw, pa.float64()), b.column("toxic")], names=["raw", "toxic"])

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    votes = rows.repartition(parts).mapInArrow(left_out, "raw double, toxic int").orderBy("raw", "toxic").toPandas()
    return Model(shared, *fit_curve(votes["raw"].to_numpy(), votes["toxic"].to_numpy(np.float64)))


def toxicity(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score, predicted, evidence): score in [0, 1] from the text alone; evidence are the nearest examples' ids.

    Texts without a word of any example, null and empty ones too, get the calibrated base rate and no evidence. Repeated
    rows score alike; a null doc_id stays null. Without a model (no labels of one kind) every score is 0. Other columns
    are ignored.
    """
    core, slope, shift = (model.core, model.slope, model.shift) if model else (None, 0.0, 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            raw, evidence = core.value.raw(b.column("text")) if core else ([], [[]] * b.num_rows)
            score = [calibrated(x, slope, shift) for x in raw] if core else [0.0] * b.num_rows
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32()), pa.array(evidence, pa.list_(pa.int64()))],
                names=["doc_id", "score", "predicted", "evidence"],
            )

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int, evidence array<long>")


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: doc_id, held_out, score, predicted; then evidence."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels.where(~held_out()))
    return toxicity(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted", "evidence")
