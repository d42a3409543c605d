"""Quality rules with adaptive thresholds: mergeable quantile sketches per language and source, joined back as filters.

Each document gets counts of symbols, repeated lines and repeated words, set against its size, and a mean word length. Quantile
sketches are built per (lang, source), merged upwards per language and over everything, and a group with too few documents
uses the next wider sketch. A sketch counts values in bins whose borders grow by a constant factor, so it is bounded, merges
by adding, knows every quantile to half a per cent and, unlike a randomised one, never changes in a rerun. A document goes
when a value lies beyond its group's fence, the upper quartile plus a multiple of the interquartile range, or when it fails
the fixed base rule. Most documents have no symbols, so symbols are compared as square roots of (count + 3/8) / characters, which
differ among documents without any by their length, and on which chance spreads every rate alike, by 0.5 / sqrt(characters). Half of
that, at the group's median length, is the least range of a group. Repeats are rare too, and come in bunches: their quartiles are
those of the values above 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from framespark.llm.common import Words, bound_batches, mix, slices, stash, text_bytes, work_dir

#: Characters that count as symbols (fixed values).
SYMBOLS = "#*$%&|<>"
#: Base rule.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A group's own sketch counts from so many documents that pass the base rule; else that of its language, else of all.
MIN_GROUP = 100
#: Multiple of the interquartile range that lies between the upper quartile and the fence, for every value.
MULTIPLE = 8.0
#: value -> least interquartile range that counts, which only bridges equal values; that of symbols is CHANCE / sqrt(the group's
#: median characters). Mean word length also has a lower fence as far below the lower quartile.
FENCES = {"symbol_ratio": None, "dup_line_ratio": 0.00125, "repeat_ratio": 0.00125, "word_length": 0.0625}
CHANCE = 0.25
#: Values that are 0 for most documents of any group: only those above 0 go into the sketch, which counts from so many.
ABOVE_ZERO = ("dup_line_ratio", "repeat_ratio")
MIN_ABOVE_ZERO = 20
#: Factor between the borders of a sketch's bins, and the bin of zero.
GROWTH, ZERO = 1.01, -(1 << 30)

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def measure_slice(col: pa.Array) -> list[np.ndarray]:
    data, off = text_bytes(col)
    n = len(off) - 1
    w = Words(data, off)
    # sums over documents by prefix sums, since reduceat mishandles empty ranges
    letters = np.concatenate(([0], np.cumsum(((data & 0xC0) != 0x80) & (data != 32) & ((data < 9) | (data > 13)))))
    is_symbol = np.zeros(256, bool)
    is_symbol[list(SYMBOLS.encode())] = True
    symbols = np.concatenate(([0], np.cumsum(is_symbol[data])))
    word_chars = letters[off[1:]] - letters[off[:-1]]
    n_symbols = symbols[off[1:]] - symbols[off[:-1]]

    at, h = w.windows(3)
    repeat = np.zeros(n, np.int64)
    if len(at):
        key = h ^ mix(w.doc[at].astype(np.uint64))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(len(w.start) + 3, np.int64)
        first = at[twice]
        np.add.at(covered, first, 1)
        np.add.at(covered, first + 3, -1)
        inside = np.cumsum(covered)[: len(w.start)] > 0
        repeat = np.bincount(w.doc[inside], minlength=n)

    # lines: pieces between \n inside one document that have a word
    dup = np.zeros(n, np.int64)
    breaks = np.flatnonzero(data == 10)
    starts = np.union1d(off[:-1], breaks + 1)
    starts = starts[starts < len(data)]
    if len(starts):
        ends = np.append(starts[1:], len(data))
        line_doc = np.searchsorted(off, starts, side="right") - 1
        # the \n that ends a line is no part of it
        ends = ends - (data[ends - 1] == 10)
        has_word = np.searchsorted(w.start, ends) > np.searchsorted(w.start, starts)
        starts, ends, line_doc = starts[has_word], ends[has_word], line_doc[has_word]
        raw = data.tobytes()
        seen: set[bytes] = set()
        now = -1
        for s, e, d in zip(starts.tolist(), ends.tolist(), line_doc.tolist(), strict=True):
            if d != now:
                seen, now = set(), d
            line = raw[s:e]
            if line in seen:
                dup[d] += 1
            else:
                seen.add(line)
    return [w.per_doc, word_chars, n_symbols, dup, repeat]


def measure(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs plus the five counts of MEASURES (columns of those names are replaced), without the text if keep_text is off.

    A null or empty text counts 0 everywhere. The work is linear in the text, one slice of about a megabyte at a time.
    """
    bound_batches(docs.sparkSession)
    names = [x.split()[0] for x in MEASURES.split(", ")]
    docs = docs.drop(*names)
    rest = [c for c in docs.columns if keep_text or c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            cols = measure_slice(b.column(text))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), *(pa.array(c, pa.int64()) for c in cols)], names=[*rest, *names])

    out = StructType([*(docs.schema[c] for c in rest), *(StructField(name, LongType()) for name in names)])
    return docs.mapInArrow(run, out)


def _value(name: str) -> Column:
    part = lambda a, b: F.when(F.col(b) > 0, a / F.col(b)).otherwise(F.lit(0.0))
    return {
        "symbol_ratio": F.sqrt(part(F.col("n_symbols") + 0.375, "word_chars")),
        "dup_line_ratio": part(F.col("n_dup_lines"), "n_lines_scale"),
        "repeat_ratio": part(F.col("n_repeat_words"), "n_words"),
        "word_length": part(F.col("word_chars"), "n_words"),
        "word_chars": F.col("word_chars").cast("double"),
    }[name]


def judge(measured: DataFrame, lang: str = "lang", source: str = "source", folder: str | None = None) -> DataFrame:
    """measured plus base_failed, kept and reasons (names of the fences that the document lies beyond).

    Null languages and sources form groups of their own. Ratios with a zero denominator are 0. An empty table gives an
    empty table. Bins are counted on the map side: a source with a third of all rows sends one sketch a task.
    """
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    # repeated lines are set against the words, a scale that every document has: 10 words count as a line
    m = measured.withColumn("base_failed", base).withColumn("n_lines_scale", F.greatest(F.col("n_dup_lines"), F.col("n_words") / 10))
    sketched = [*FENCES, "word_chars"]
    m = m.withColumn("_q", F.struct(*[_value(k).alias(k) for k in sketched])).drop("n_lines_scale")
    by = [F.col(lang).alias("_lang"), F.col(source).alias("_source")]
    value = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_q.{k}").alias("v")) for k in sketched])).alias("x")
    bins = m.where("not base_failed").select(*by, value).withColumn("bin", F.when(F.col("x.v") > 0, F.ceil(F.log("x.v") / math.log(GROWTH))).otherwise(ZERO))
    own = bins.groupBy("_lang", "_source", F.col("x.k").alias("k"), "bin").agg(F.count(F.lit(1)).alias("n"))
    # small, read four times below
    own = stash(own, folder or work_dir(measured.sparkSession), "sketches")
    # the sketches of a language and of everything are merged from those of the groups; no second pass over documents
    merged = lambda *keys: own.groupBy(*keys, "k", "bin").agg(F.sum("n").alias("n"))

    def fences(sketch: DataFrame, keys: list[str], tag: str) -> DataFrame:
        """keys and tag: a struct of the bounds that the sketch gives, null where it holds too little."""
        known = (F.col("bin") > ZERO) | ~F.col("k").isin(*ABOVE_ZERO)
        part = Window.partitionBy(*keys, "k")
        s = sketch.withColumn("docs", F.sum("n").over(part)).where(known)
        s = s.withColumn("upto", F.sum("n").over(part.orderBy("bin"))).withColumn("total", F.sum("n").over(part))
        at = lambda p: F.min(F.when(F.col("upto") >= p * F.col("total"), F.col("bin")))
        q = s.groupBy(*keys, "k").agg(at(0.25).alias("low"), at(0.5).alias("mid"), at(0.75).alias("high"), F.max("total").alias("total"), F.max("docs").alias("docs"))
        middle = lambda b: F.when(F.col(b) == ZERO, 0.0).otherwise(F.pow(F.lit(GROWTH), F.col(b)) * 2 / (1 + GROWTH))
        q = q.withColumns({c: middle(c) for c in ("low", "mid", "high")})
        if tag != "all":
            q = q.where((F.col("docs") >= MIN_GROUP) & (~F.col("k").isin(*ABOVE_ZERO) | (F.col("total") >= MIN_ABOVE_ZERO)))
        of = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
        cols = []
        for k, least in FENCES.items():
            span = MULTIPLE * F.greatest(of(k, "high") - of(k, "low"), F.lit(least) if least else CHANCE / F.sqrt(of("word_chars", "mid")))
            cols.append((of(k, "high") + span).alias(f"{k}_high"))
            if k == "word_length":
                cols.append((of(k, "low") - span).alias(f"{k}_low"))
        return q.groupBy(*keys).agg(*cols).select(*keys, F.struct(*[F.col(c) for c in bounds]).alias(tag))

    bounds = [*[f"{k}_high" for k in FENCES], "word_length_low"]
    g, pl, al = fences(own, ["_lang", "_source"], "own"), fences(merged("_lang"), ["_lang"], "of_lang"), fences(merged(), [], "all")
    names = own.select("_lang", "_source").distinct()
    rules = names.join(g, names["_lang"].eqNullSafe(g["_lang"]) & names["_source"].eqNullSafe(g["_source"]), "left").select(names["_lang"], names["_source"], "own")
    rules = (
        rules.join(pl, rules["_lang"].eqNullSafe(pl["_lang"]), "left")
        .crossJoin(F.broadcast(al))  # one row
        .select(rules["_lang"], rules["_source"], F.struct(*[F.coalesce(*[f"{t}.{b}" for t in ("own", "of_lang", "all")]).alias(b) for b in bounds]).alias("_fence"))
    )
    # groups none of whose documents pass the base rule have no sketch; all their documents go anyway. A ratio that is 0
    # everywhere has no fence and needs none
    j = m.join(rules, m[lang].eqNullSafe(rules["_lang"]) & m[source].eqNullSafe(rules["_source"]), "left")
    tests = []
    for k in FENCES:
        tests.append(F.when(F.col(f"_q.{k}") > F.col(f"_fence.{k}_high"), F.lit(f"{k}_high")))
        if k == "word_length":
            tests.append(F.when(F.col(f"_q.{k}") < F.col(f"_fence.{k}_low"), F.lit(f"{k}_low")))
    reasons = F.filter(F.array(*tests), lambda x: x.isNotNull())
    return j.withColumn("reasons", reasons).withColumn("kept", ~F.col("base_failed") & (F.size("reasons") == 0)).drop("_q", "_fence", "_lang", "_source")


def quality_rules(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """One row per row of docs (doc_id, lang, source, text): the counts, base_failed, kept and reasons.

    Null texts have no words and fail the base rule; repeated rows are judged alike; other columns are ignored.
    The counts (no texts) are written to the shared folder, since both the sketches and the verdicts read them.
    """
    measured = measure(docs.select("doc_id", "lang", "source", "text"), keep_text=False)
    folder = folder or work_dir(docs.sparkSession)
    return judge(stash(measured, folder, "measured"), folder=folder)


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs.

    Columns are numbered while the rules run, so none can clash with a count or a verdict. The texts are measured once
    for the sketches and once on their way out, which is cheaper than writing them to disk in between.
    """
    at = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    judged = judge(measure(docs.toDF(*at.values()), at["text"]), at["lang"], at["source"])
    return judged.where("kept").select(*[F.col(v).alias(c) for c, v in at.items()])


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept; then reasons."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.concat_ws(",", "reasons").alias("reasons")
    )
