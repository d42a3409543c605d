"""Token counts by count-only Viterbi over a unigram vocabulary.

Every piece of the vocabulary has a score; the best segmentation of a text is the one with the greatest sum. An Aho-
Corasick automaton lists all pieces that end at each character, longest first, and dynamic programming carries only
the best score and the number of pieces. Ties follow the tokenizers library's unigram model: ends are settled in
order of their piece's start and only a strictly greater score replaces, so of equal sums the earliest start stays;
a character without a piece of its own costs the least score less 10; a run of unknown characters is one piece, or its
UTF-8 bytes where the vocabulary has byte pieces.

White space becomes the mark U+2581, one stands before the text, and no piece is sought across the mark, so a text's
count is the sum over its marked words. A task counts each distinct word once and remembers it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from framespark.llm.common import slices

MODEL = "piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Words a task remembers; the memory is started anew beyond it, which changes no result.
WORD_MEMORY = 1_000_000


def load_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a SentencePiece model file, in order of id.

    The file gives its pieces scores that fall with their rank; they are taken as the scores of a unigram model.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), float(sp.get_score(i))) for i in range(sp.get_piece_size())]


class Counter:
    """Counts of pieces of the best segmentation."""

    def __init__(self, vocabulary: list[tuple[str, float]], unknown: int = 0):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(vocabulary):
            if piece and i != unknown:
                self.auto.add_word(piece, (len(piece), score))
        self.auto.make_automaton()
        self.worst = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        names = {p for p, _ in vocabulary}
        self.bytes = all(f"<0x{b:02X}>" in names for b in range(256))
        self.known: dict[str, int] = {}

    def segment(self, word: str) -> int:
        """Pieces of one marked word. Matches come by their end, longest first, so ends are settled one after another."""
        best, count, unknown = [0.0], [0], [False]
        none, worst = float("-inf"), self.worst
        top, start, single = none, 0, False

        def settle() -> None:
            """The best piece that ends at the character after the last settled one, a lone unknown character included."""
            at = len(best) - 1
            lone = not single and best[at] + worst > top
            best.append(best[at] + worst if lone else top)
            unknown.append(lone)
            if not lone:
                count.append(count[start] + 1)
            elif self.bytes:
                count.append(count[at] + len(word[at].encode()))
            else:
                count.append(count[at] + (not unknown[at]))

        for end, (length, score) in self.auto.iter(word):
            while len(best) <= end:
                settle()
                top, single = none, False
            s = best[end + 1 - length] + score
            # a later start replaces only with a greater score
            if s > top:
                top, start = s, end + 1 - length
            if length == 1:
                single = True
        while len(best) <= len(word):
            settle()
            top, single = none, False
        return count[-1]

    def of(self, word: str) -> int:
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= WORD_MEMORY:
                self.known.clear()
            got = self.known[word] = self.segment(MARK + word)
        return got

    def text(self, text: str | None) -> int:
        """Pieces of a text; 0 for null and empty ones.

        Each blank begins a marked word, also an empty one; the first word has a mark unless the text begins with one.
        """
        if not text:
            return 0
        words = text.replace(MARK, " ").split(" ")
        if not words[0]:
            del words[0]
        known = self.known
        try:
            return sum([known[x] for x in words])
        except KeyError:
            return sum([self.of(x) for x in words])


_COUNTERS: dict[str, Counter] = {}


def counter_of(model: str) -> Counter:
    """The worker process's counter, kept from task to task with the words it knows."""
    import public_tokenizers

    if model not in _COUNTERS:
        _COUNTERS[model] = Counter(load_vocabulary(public_tokenizers.path(model)))
    return _COUNTERS[model]


def token_counts(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, n_chars, n_tokens) of each row of docs (doc_id, text).

    Null and empty texts have 0 tokens; repeated rows and rows without a doc_id are counted like any other; other
    columns are ignored; an empty table gives no rows. Texts are counted whole, whatever their length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(model)
        for b in slices(batches):
            texts = b.column("text").to_pylist()
            n = np.fromiter(map(counter.text, texts), np.int64, len(texts))
            chars = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(chars), pa.array(n)], names=["doc_id", "n_chars", "n_tokens"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, n_tokens long")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, n_tokens of every document."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
