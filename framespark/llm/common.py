"""Shared helpers: working folder, vectorised words and hashes, packed rows, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python task works on at once; a longer document forms a slice of its own.
SLICE_BYTES = 1 << 20

#: Bytes of an Arrow batch; a batch stands in memory on both sides, beside the slice that is worked on.
BATCH_BYTES = 4 << 20

#: ASCII white space of the word pattern [^\x20\x09-\x0D]+.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------- working folder


def work_dir(spark: SparkSession) -> str:
    """A new folder below the shared folder named in spark.checkpoint.dir. Only a local session (tests) may leave it unset: it gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.gettempdir()
    return f"{root.rstrip('/')}/framespark-{uuid.uuid4().hex}"


def stash(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: a cut of the lineage that outlives lost executors."""
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ---------------------------------------------------------------- hashes


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser, elementwise on uint64."""
    x = x + GOLDEN
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_TABLE = mix(np.arange(256, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_TABLE[SPACE] = 0
_R = 0x5851F42D4C957F2D
_RI = pow(_R, -1, 1 << 64)
_POW: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**i mod 2**64 for i < n; kept, and grown when a longer slice comes."""
    have = _POW.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        p = np.full(size, base, dtype=np.uint64)
        p[0] = 1
        _POW[base] = have = np.multiply.accumulate(p)
    return have[:n]


# ---------------------------------------------------------------- slices of text columns


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the text column of each piece has about ``limit`` bytes (or is one document)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ends = np.cumsum(lengths(batch.column(column)))
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
    release()


def bound_batches(spark: SparkSession) -> None:
    """Let rows go to Python workers in batches of at most BATCH_BYTES, where the session sets no bound of its own; it concerns memory on either side alone."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, str(BATCH_BYTES))


def release() -> None:
    """Give what the worker process has freed back to the system: workers outlive their tasks, and all of an executor share its memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def lengths(col: pa.Array) -> np.ndarray:
    """Bytes of each value, 0 for null."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all values joined, offsets of length n + 1); null counts as empty."""
    col = col.fill_null("")
    col = col.cast(pa.large_string()) if not pa.types.is_large_string(col.type) else col
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[off[0] : off[-1]] if raw is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, (off - off[0]).copy()


class Words:
    """Words of a slice of documents: start, end (byte positions), doc (row number), hash (uint64 of the bytes)."""

    def __init__(self, data: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE):
        n = len(data)
        self.data, self.off = data, off
        inside = ~space[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cuts = off[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        first[cuts] = inside[cuts]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        last[cuts - 1] = inside[cuts - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.doc = np.searchsorted(off, self.start, side="right") - 1
        if len(self.start):
            letters = _TABLE[data] if space is SPACE else np.where(inside, _TABLE[data], np.uint64(0))
            sums = np.add.reduceat(letters * powers(_R, n), self.start)
            self.hash = mix(sums * powers(_RI, n)[self.start])
        else:
            self.hash = np.zeros(0, np.uint64)
        self.per_doc = np.bincount(self.doc, minlength=len(off) - 1)
        self.first = np.concatenate(([0], np.cumsum(self.per_doc)))

    def prefixes(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the word, hash of its first k characters) of every word that is longer than k characters."""
        if not len(self.start):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        n = len(self.data)
        leads = np.append(np.flatnonzero((self.data & 0xC0) != 0x80), np.full(k, n))
        cut = leads[np.minimum(np.searchsorted(leads, self.start) + k, len(leads) - 1)]
        longer = np.flatnonzero(cut < self.end)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_TABLE[self.data] * powers(_R, n))))
        start = self.start[longer]
        return longer, mix((sums[cut[longer]] - sums[start]) * powers(_RI, n)[start] + np.uint64(k))

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every run of k words inside one document."""
        m = len(self.hash) - k + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[:m] == self.doc[k - 1 :])
        h = np.zeros(m, np.uint64)
        for i in range(k):
            h = h * np.uint64(0x9FB21C651E98DF25) + self.hash[i : i + m]
        return at, mix(h[at])


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices starts[i], starts[i] + 1, ... (counts[i] of them) for each i, joined."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def runs_of(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[dict[str, list]]:
    """The rows of each run of equal keys, as lists of columns; rows come sorted by the keys."""
    now, rows = None, None
    for b in batches:
        cols = {c: b.column(c).to_pylist() for c in b.schema.names}
        key = list(zip(*(cols[k] for k in keys), strict=True))
        cuts = [i for i in range(1, len(key)) if key[i] != key[i - 1]]
        for x, y in zip([0, *cuts], [*cuts, len(key)], strict=True):
            if x == y:
                continue
            if rows is None or key[x] != now:
                if rows is not None:
                    yield rows
                now, rows = key[x], {c: [] for c in cols}
            for c, v in cols.items():
                rows[c].extend(v[x:y])
    if rows is not None:
        yield rows
    release()


# ---------------------------------------------------------------- joins


SALTS = 8


def salted_join(left: DataFrame, right: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """Inner or left join of left, any number of rows of a key, with right, one row of a key: rows of a key are dealt over SALTS tasks.

    A key that a third of all rows share then stands in many tasks, and since both sides have an exchange of their own
    a part that is still large can be split at run time. Rows of right are repeated SALTS times; they must be narrow.
    """
    l = left.withColumn("_salt", F.pmod(F.xxhash64(F.lit(3), by), F.lit(SALTS)).cast("int"))
    r = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return l.join(r, [key, "_salt"], how).drop("_salt")


# ---------------------------------------------------------------- components


def components(edges: DataFrame, folder: str, name: str, rounds: int = 40) -> DataFrame:
    """(id, comp): smallest id that each end of the undirected edges (a, b) reaches.

    Every round each vertex takes the smallest label among itself and its neighbours, then the label of that label
    (pointer jumping), so the number of rounds grows with the logarithm of the longest path. Each round is written to
    the shared folder. Labels are aggregated on the map side, and both joins have exchanges of their own on either side, so
    that the rows of a vertex with many edges, or of a component with many vertices, are split at run time.
    """
    spark = edges.sparkSession
    both = stash(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(),
        folder,
        f"{name}-edges",
    )
    labels = stash(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("comp")), folder, f"{name}-0")
    for i in range(1, rounds + 1):
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        hop = labels.join(near, "id").select("id", F.least("comp", "near").alias("comp"), F.col("comp").alias("was"))
        jump = labels.select(F.col("id").alias("comp"), F.col("comp").alias("up"))
        new = hop.join(jump, "comp", "left").select("id", F.least("comp", "up").alias("comp"), "was")
        new = stash(new, folder, f"{name}-{i}")
        changed = new.where("comp <> was").limit(1).count()
        labels = new.select("id", "comp")
        if not changed:
            return labels
    raise RuntimeError(f"labels still change after {rounds} rounds")


# ---------------------------------------------------------------- SQL of the checks

#: A table ``tab`` with the list ``crc`` of the CRC-32 checksum, by a recursive table ``bits`` (the polynomial, bits reversed, is a fixed value).
CRC_TABLE_SQL = """bits as (
  select i, i as c, 0 as k from range(256) t(i)
  union all
  select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bits where k < 8
), tab as (select list(c order by i) as crc from bits where k = 8)"""

#: The unsigned CRC-32 of the UTF-8 bytes of a column f, with tab beside it.
CRC_SQL = """xor(list_reduce(list_prepend(4294967295, list_transform(range(0, octet_length(encode(f))), lambda i: ('0x' || hex(encode(f))[2 * i + 1 : 2 * i + 2])::bigint)),
        lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295)"""
