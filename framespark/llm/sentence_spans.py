"""Substring dedup by sliding sentence spans: every run of consecutive pieces of sentences is hashed and joined globally.

A piece ends at a word that closes with . ! ? , ; or :, or at a line break. Sentences alone are too coarse: where a passage
starts or ends inside a sentence, the whole of that sentence would be lost to the comparison. A run of three or two
consecutive pieces with enough words counts as repeated if its words occur as such a run elsewhere, in any document; the first
occurrence (smallest doc_id, then position) stays, and every piece that some other occurrence covers is removed. Shorter
runs need more words, so that everyday phrases are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framespark.llm.common import _R, _RI, Words, mix, powers, salted_join, slices, stash, text_bytes, work_dir

#: Pieces of a run -> its least words.
RUNS = {3: 15, 2: 20}
#: Marks that end a piece.
MARKS = ".!?,;:"


class Sentences:
    """Pieces of a slice: index of the first word, document, hash of the words, and number of words."""

    def __init__(self, data: np.ndarray, off: np.ndarray, marks: str = MARKS):
        ends = np.zeros(256, bool)
        ends[list(marks.encode())] = True
        w = self.words = Words(data, off)
        n = len(w.start)
        first = np.ones(n, bool)
        if n:
            breaks = np.concatenate(([0], np.cumsum(data == 10)))
            gap = breaks[w.start[1:]] - breaks[w.end[:-1]] > 0
            first[1:] = gap | ends[data[w.end[:-1] - 1]] | (w.doc[1:] != w.doc[:-1])
        self.first = np.flatnonzero(first)
        self.doc = w.doc[self.first]
        self.size = np.diff(np.append(self.first, n))
        self.per_doc = np.bincount(self.doc, minlength=len(off) - 1)
        if n:
            sums = np.add.reduceat(w.hash * powers(_R, n), self.first)
            self.hash = mix(sums * powers(_RI, n)[self.first] + self.size.astype(np.uint64))
        else:
            self.hash = np.zeros(0, np.uint64)

    def runs(self, size: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(first piece, hash) of each run of so many pieces inside one document that has enough words."""
        m = len(self.hash) - size + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        words = np.convolve(self.size, np.ones(size, np.int64), "valid")
        at = np.flatnonzero((self.doc[:m] == self.doc[size - 1 :]) & (words >= least))
        h = np.full(m, size, np.uint64)
        for i in range(size):
            h = h * np.uint64(0x9FB21C651E98DF25) + self.hash[i : i + m]
        return at, mix(h[at])


def _runs(marks: str, runs: dict[int, int]):
    most = max(runs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            s = Sentences(*text_bytes(b.column("text")), marks)
            base = np.concatenate(([0], np.cumsum(s.per_doc)))
            for size, least in runs.items():
                at, h = s.runs(size, least)
                doc = s.doc[at]
                # place and number of pieces in one number
                code = (at - base[doc]) * (most + 1) + size
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(doc)), pa.array(code, pa.int64()), pa.array(h.view(np.int64))], names=["doc_id", "place", "h"])

    return run


def _cut(marks: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            data, off = text_bytes(b.column("text"))
            s = Sentences(data, off, marks)
            n = len(off) - 1
            base = np.concatenate(([0], np.cumsum(s.per_doc)))
            gone = np.zeros(len(s.first), bool)
            for d, hit in enumerate(b.column("places")):
                if hit.is_valid:
                    place, size = np.divmod(hit.values.to_numpy(), most + 1)
                    at = (base[d] + place)[:, None] + np.arange(most)
                    gone[at[(at < base[d + 1]) & (np.arange(most) < size[:, None])]] = True
            # a piece reaches to the next one of its document; blanks before the first belong to it
            start = s.words.start[s.first] if len(s.first) else np.zeros(0, np.int64)
            starts_doc = np.concatenate(([True], s.doc[1:] != s.doc[:-1])) if len(s.doc) else np.zeros(0, bool)
            start = np.where(starts_doc, off[s.doc], start)
            end = np.where(np.append(starts_doc[1:], True), off[s.doc + 1], np.append(start[1:], 0)) if len(s.doc) else start
            cover = np.zeros(len(data) + 1, np.int64)
            cover[start[gone]] += 1
            np.add.at(cover, end[gone], -1)
            keep = np.cumsum(cover[:-1]) == 0
            kept = np.concatenate(([0], np.cumsum(keep)))[off]
            text = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(kept.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[keep]))]).cast(pa.string())
            removed = np.bincount(s.doc[gone], minlength=n)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s.per_doc, pa.int64()), pa.array(removed, pa.int64()), text], names=["doc_id", "n_pieces", "n_removed", "text"])

    return run


def repeated_runs(docs: DataFrame, folder: str | None = None, marks: str = MARKS, runs: dict[int, int] | None = None) -> DataFrame:
    """(doc_id, place): the runs that are no first occurrence, as first piece times (longest run + 1), plus pieces."""
    folder = folder or work_dir(docs.sparkSession)
    texts = docs.where("doc_id is not null").selectExpr("cast(doc_id as long) as doc_id", "text")
    # cheaper to hash twice than to keep; of the runs only the repeated ones are written
    found = texts.mapInArrow(_runs(marks, runs or RUNS), "doc_id long, place long, h long")
    # rows that repeat a doc_id repeat its runs; they are the same occurrence
    first = found.groupBy("h").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stash(salted_join(found, first.select("h", "least"), "h", "doc_id"), folder, "repeated")
    # inside the first document too only its first place stays
    places = shared.where("doc_id = least").groupBy("h").agg(F.min("place").alias("stays"))
    return salted_join(shared, places, "h", "doc_id").where("not (doc_id = least and place = stays)").select("doc_id", "place").distinct()


def remove_repeated_spans(docs: DataFrame, folder: str | None = None, marks: str = MARKS, runs: dict[int, int] | None = None) -> DataFrame:
    """(doc_id, n_pieces, n_removed, text): pieces, removed pieces and the text that stays of each row of docs.

    Null texts become empty; texts without a run of enough words stay whole; rows without a doc_id are neither compared
    nor cut; rows that repeat a doc_id count as one document; other columns are ignored.
    """
    runs = runs or RUNS
    repeated = repeated_runs(docs, folder, marks, runs).groupBy("doc_id").agg(F.collect_list("place").alias("places")).withColumnRenamed("doc_id", "_id")
    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    j = rows.join(repeated, rows["doc_id"] == repeated["_id"], "left").select("doc_id", "text", "places")
    return j.mapInArrow(_cut(marks, max(runs)), "doc_id long, n_pieces long, n_removed long, text string")


def op6_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, n_removed, text (what stays) of every document."""
    return remove_repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
