"""Token ids in wavelet-matrix shard files: bit planes with rank directories, one file row per shard.

Documents are range-partitioned by doc_id; each task encodes its run of documents and writes shards of bounded size.
A shard holds the ids as bit planes from the highest bit down, each plane stably sorted by the bits above it, plus
cumulative counts of ones per block of 512 bits. From that one row tokens are accessed, counted and located, and all
documents are decoded again. The table is Parquet with zstd, which takes the redundancy out of the high planes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framespark.llm.common import SPACE, bound_batches, ragged, slices, text_bytes, work_dir

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: A shard is closed when it has so many ids (a longer document still stays whole).
SHARD_IDS = 1 << 22
#: Pieces whose ids a worker remembers (some 50 MB); the memory is started anew beyond it, which changes no result.
WORD_MEMORY = 1 << 18
BLOCK_BITS = 512
#: Bytes of text encoded at once: the larger, the fewer times a frequent piece is looked up.
SLICE = 2 << 20
SHARD_SCHEMA = "shard long, n_ids long, doc_ids binary, n_tokens binary, zeros array<long>, planes array<binary>, ranks array<binary>"


# ---------------------------------------------------------------- wavelet matrix


class WaveletMatrix:
    """Bit planes of a sequence of non-negative integers below 2**len(planes)."""

    def __init__(self, n: int, zeros: list[int], planes: list[np.ndarray], ranks: list[np.ndarray]):
        self.n, self.zeros, self.planes, self.ranks = n, zeros, planes, ranks

    @staticmethod
    def build(ids: np.ndarray, bits: int) -> WaveletMatrix:
        zeros, planes, ranks = [], [], []
        for level in range(bits - 1, -1, -1):
            one = (ids >> level) & 1 == 1
            packed = np.packbits(one)
            packed = np.pad(packed, (0, -len(packed) % (BLOCK_BITS // 8)))
            per_block = np.bitwise_count(packed.reshape(-1, BLOCK_BITS // 8)).sum(axis=1, dtype=np.uint32)
            ranks.append(np.concatenate(([0], np.cumsum(per_block))).astype(np.uint32))
            planes.append(packed)
            low = ids[~one]
            zeros.append(len(low))
            ids = np.concatenate((low, ids[one]))
        return WaveletMatrix(int(len(ids)), zeros, planes, ranks)

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones before each position of a plane: a directory entry plus the bits of at most one block."""
        block = at // BLOCK_BITS
        count = self.ranks[level][block].astype(np.int64)
        plane = np.append(self.planes[level], np.zeros(BLOCK_BITS // 8, np.uint8))
        rows = plane[(block * (BLOCK_BITS // 8))[:, None] + np.arange(BLOCK_BITS // 8)]
        bits = np.unpackbits(rows, axis=1)
        return count + (bits * (np.arange(BLOCK_BITS) < (at - block * BLOCK_BITS)[:, None])).sum(axis=1, dtype=np.int64)

    def access(self, at: np.ndarray) -> np.ndarray:
        """Values at the positions."""
        at = np.asarray(at, np.int64)
        out = np.zeros(len(at), np.int64)
        for level, zeros in enumerate(self.zeros):
            bit = (self.planes[level][at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            ones = self._ones(level, at)
            out = out * 2 + bit
            at = np.where(bit, zeros + ones, at - ones)
        return out

    def rank(self, value: int, at: int) -> int:
        """Occurrences of value before a position."""
        return self._range(value, at)[1] - self._range(value, at)[0]

    def _range(self, value: int, at: int) -> tuple[int, int]:
        lo, hi = 0, at
        for level, zeros in enumerate(self.zeros):
            ones = self._ones(level, np.array([lo, hi]))
            if value >> (len(self.zeros) - 1 - level) & 1:
                lo, hi = zeros + int(ones[0]), zeros + int(ones[1])
            else:
                lo, hi = lo - int(ones[0]), hi - int(ones[1])
        return lo, hi

    def select(self, value: int) -> np.ndarray:
        """Positions of all occurrences, found by walking its run on the last plane back up."""
        lo, hi = self._range(value, self.n)
        at = np.arange(lo, hi)
        for level in range(len(self.zeros) - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.n).astype(bool)
            want = value >> (len(self.zeros) - 1 - level) & 1
            at = np.flatnonzero(one)[at - self.zeros[level]] if want else np.flatnonzero(~one)[at]
        return np.sort(at)

    def decode(self) -> np.ndarray:
        """The whole sequence: the stable partitions are undone plane by plane from the lowest bit."""
        ids = np.zeros(self.n, np.uint32 if len(self.zeros) > 16 else np.uint16)
        for level in range(len(self.zeros) - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.n).astype(bool)
            up = np.empty_like(ids)
            up[~one] = ids[: self.zeros[level]]
            up[one] = ids[self.zeros[level] :] | ids.dtype.type(1 << (len(self.zeros) - 1 - level))
            ids = up
        return ids


# ---------------------------------------------------------------- encoding


#: Kinds of bytes: white space, letters, digits, other printable ASCII, and all that the plain path leaves alone.
BLANK, LETTER, DIGIT, SIGN, OTHER = range(5)
KIND = np.full(256, OTHER, np.uint8)
KIND[33:127] = SIGN
KIND[SPACE] = BLANK
KIND[list(range(65, 91)) + list(range(97, 123))] = LETTER
KIND[48:58] = DIGIT
KIND[39] = OTHER  # an apostrophe may begin a contraction
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The normalizer and pre-tokenizer (fixed values) for which the plain path gives the library's ids.
PLAIN_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PLAIN_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest for the characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """Ids of documents by the tokenizers library.

    Texts of ASCII and Latin-1 letters are cut into the pre-tokenizer's pieces (runs of lower-cased letters, single
    digits, runs of signs) for a whole slice at once, and the library's BPE model encodes each distinct piece once; the
    worker process remembers them. Texts with anything else, apostrophes or special tokens, and any other tokenizer
    than the one that the pieces are known to fit, go through the library's whole pipeline.
    """

    def __init__(self, path: str):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.bits = max(int(self.tok.get_vocab_size() - 1).bit_length(), 1)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("normalizer") or {}).get("normalizers")
        cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.plain = steps == PLAIN_NORMALIZERS and cuts[0].get("pattern") == {"Regex": PLAIN_PATTERN} and cuts[-1].get("type") == "ByteLevel"
        self.alphabet = byte_letters()
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.count = np.zeros(1 << 16, np.int64)
        self.first = np.zeros(1 << 16, np.int64)
        self.pool = np.zeros(1 << 20, np.uint32)
        self.used = 0

    def _piece(self, piece: bytes) -> list[int]:
        text = piece.decode("ascii") if piece.isascii() else piece.decode("latin-1").translate(self.alphabet)
        return [t.id for t in self.model.tokenize(text)]

    def _learn(self, new: list[bytes]) -> None:
        if not new:
            return
        got = list(map(self._piece, new))
        count = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.array([x for ids in got for x in ids], np.uint32)
        n, used = len(self.known), self.used + len(flat)
        while used > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        while n + len(new) > len(self.count):
            self.count = np.concatenate((self.count, np.zeros_like(self.count)))
            self.first = np.concatenate((self.first, np.zeros_like(self.first)))
        self.pool[self.used : used] = flat
        self.count[n : n + len(new)] = count
        self.first[n : n + len(new)] = self.used + np.cumsum(count) - count
        self.used = used
        self.known.update(zip(new, range(n, n + len(new)), strict=True))

    def _pieces(self, data: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(pieces of the plain documents, their documents, documents that aren't plain)."""
        kind, low = KIND[data], LOWER[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)
        # the letters of the second half of Latin-1, but for the signs of multiplication and division
        lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
        kind[lead] = kind[lead + 1] = LETTER
        low[lead + 1] |= 0x20
        # the small sharp s has no capital here: 0x9F is lower case already
        low[lead[data[lead + 1] == 0x9F] + 1] = 0x9F
        odd = np.flatnonzero((kind == OTHER) | ((data == 0x3C) & np.append(data[1:] == 0x7C, False)))
        odd = np.unique(np.searchsorted(off, odd, side="right") - 1)
        for d in odd.tolist():
            kind[off[d] : off[d + 1]] = BLANK
        first = kind != BLANK
        last = first.copy()
        change = kind[1:] != kind[:-1]
        change |= kind[1:] == DIGIT
        cuts = off[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        change[cuts - 1] = True
        first[1:] &= change
        last[:-1] &= change
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        at = np.concatenate(([0], np.cumsum(end - start))).astype(np.int64)
        letters = np.ascontiguousarray(low[kind != BLANK])
        pieces = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(letters)])
        return pieces, np.searchsorted(off, start, side="right") - 1, odd

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents joined, END_ID after each; ids of each document)."""
        data, off = text_bytes(col)
        n = len(off) - 1
        if self.plain and len(data):
            pieces, doc, odd = self._pieces(data, off)
        else:
            pieces, doc, odd = pa.array([], pa.large_binary()), np.zeros(0, np.int64), np.arange(n)
        coded = pieces.dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.known) + len(words) > WORD_MEMORY:
            self._forget()
        self._learn([x for x in words if x not in self.known])
        entry = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy()]
        first, count, pool = self.first[entry], self.count[entry], self.pool
        if len(odd):
            rest = [e.ids for e in self.tok.encode_batch_fast([col[d].as_py() or "" for d in odd.tolist()], add_special_tokens=False)]
            size = np.array([len(x) for x in rest], np.int64)
            pool = np.concatenate((pool[: self.used], np.array([x for ids in rest for x in ids], np.uint32)))
            doc, first, count = np.concatenate((doc, odd)), np.concatenate((first, self.used + np.cumsum(size) - size)), np.concatenate((count, size))
            order = np.argsort(doc, kind="stable")
            doc, first, count = doc[order], first[order], count[order]
        per_doc = np.bincount(doc, weights=count, minlength=n).astype(np.int64) + 1
        out = np.full(int(per_doc.sum()), END_ID, np.uint32)
        body = np.ones(len(out), bool)
        body[np.cumsum(per_doc) - 1] = False
        out[body] = pool[ragged(first, count)]
        return out, per_doc


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(tokenizer: str) -> Encoder:
    """The worker process's encoder, kept from task to task with the pieces it knows."""
    import public_tokenizers

    if tokenizer not in _ENCODERS:
        _ENCODERS[tokenizer] = Encoder(public_tokenizers.path(tokenizer))
    return _ENCODERS[tokenizer]


def write_shards(docs: DataFrame, path: str, shards: int, tokenizer: str = TOKENIZER) -> DataFrame:
    """Encode docs (doc_id, text), write the shard table to path in ascending doc_id order, and return it as read back.

    Null texts count as empty and have the end id alone; rows without a doc_id come first; rows that repeat a doc_id
    each have an entry. Other columns are ignored. ``shards`` is the number of range partitions; each may write several
    shards, so that none outgrows memory. An empty table gives an empty shard table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_of(tokenizer)
        part = TaskContext.get().partitionId()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size, nth = 0, 0

        def close() -> pa.RecordBatch:
            ids, per_doc, doc_ids = (np.concatenate(x) for x in zip(*held, strict=True))
            m = WaveletMatrix.build(ids.astype(np.uint16) if enc.bits <= 16 else ids, enc.bits)
            row = {
                "shard": (part << 32) + nth, "n_ids": len(ids), "doc_ids": doc_ids.tobytes(), "n_tokens": per_doc.astype(np.uint64).tobytes(),
                "zeros": m.zeros, "planes": [p.tobytes() for p in m.planes], "ranks": [r.tobytes() for r in m.ranks],
            }
            return pa.RecordBatch.from_arrays(
                [pa.array([row["shard"]], pa.int64()), pa.array([row["n_ids"]], pa.int64()), pa.array([row["doc_ids"]], pa.binary()), pa.array([row["n_tokens"]], pa.binary()),
                 pa.array([row["zeros"]], pa.list_(pa.int64())), pa.array([row["planes"]], pa.list_(pa.binary())), pa.array([row["ranks"]], pa.list_(pa.binary()))],
                names=list(row),
            )

        for b in slices(batches, limit=SLICE):
            ids, per_doc = enc.encode(b.column("text"))
            if held and size + len(ids) > SHARD_IDS:
                yield close()
                held, size, nth = [], 0, nth + 1
            # a missing doc_id is written as the least integer, which no document may have
            held.append((ids, per_doc, b.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)))
            size += len(ids)
        if held:
            yield close()

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(run, SHARD_SCHEMA).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(SHARD_SCHEMA).parquet(path)


NO_ID = -(1 << 63)


def _matrix(b: pa.RecordBatch, i: int) -> tuple[WaveletMatrix, np.ndarray, np.ndarray]:
    v = {c: b.column(c)[i].as_py() for c in ("n_ids", "zeros", "planes", "ranks", "doc_ids", "n_tokens")}
    planes = [np.frombuffer(p, np.uint8) for p in v["planes"]]
    ranks = [np.frombuffer(r, np.uint32) for r in v["ranks"]]
    return WaveletMatrix(v["n_ids"], v["zeros"], planes, ranks), np.frombuffer(v["doc_ids"], np.int64), np.frombuffer(v["n_tokens"], np.uint64).astype(np.int64)


def digests(shards: DataFrame) -> DataFrame:
    """(shard, doc_id, local_start, n_tokens, ids_crc32) of every document, decoded from the shard table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                m, doc_ids, count = _matrix(b, i)
                ids = m.decode().astype("<u4")
                ends = np.cumsum(count)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), count.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.column("shard")[i].as_py()] * len(count), pa.int64()), pa.array(doc_ids, mask=doc_ids == NO_ID), pa.array(ends - count), pa.array(count), pa.array(crc, pa.int64())],
                    names=["shard", "doc_id", "local_start", "n_tokens", "ids_crc32"],
                )

    return shards.mapInArrow(run, "shard long, doc_id long, local_start long, n_tokens long, ids_crc32 long")


def occurrences(shards: DataFrame, token: int) -> DataFrame:
    """(doc_id, position within the document) of every occurrence of a token id, by select on the bit planes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                m, doc_ids, count = _matrix(b, i)
                at = m.select(token) if token >> len(m.zeros) == 0 else np.zeros(0, np.int64)
                ends = np.cumsum(count)
                doc = np.searchsorted(ends, at, side="right")
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids[doc], mask=doc_ids[doc] == NO_ID), pa.array(at - (ends - count)[doc], pa.int64())], names=["doc_id", "position"])

    return shards.mapInArrow(run, "doc_id long, position long")


def encoded_documents(docs: DataFrame, path: str | None = None, shards: int | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): docs are written as shards and the rows are read back from them."""
    spark = docs.sparkSession
    path = path or f"{work_dir(spark)}/token-ids"
    table = write_shards(docs, path, shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1))
    # one row per shard, millions of ids each: the running sum over shards is small whatever the corpus
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = table.select("shard", "n_ids").withColumn("before", before).select("shard", "before")
    return digests(table).join(starts, "shard").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    return encoded_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
