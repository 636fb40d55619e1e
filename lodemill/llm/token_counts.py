"""Token counts of a unigram tokenizer without its tokens: Aho-Corasick matches and a count-only Viterbi.

An Aho-Corasick automaton over the vocabulary lists every piece that ends at each character; dynamic
programming carries, for each position, the best score and the number of pieces of the best path, and keeps no
back pointers. Ties go as in the tokenizers library's unigram model: starts are gone through from the left and
a later start replaces an earlier one only with a strictly higher score, so of equal paths to a position the
one whose last piece is longest stays; a character without a piece of its own costs the least score less 10
and counts as its UTF-8 bytes (byte fallback) or else as one piece with the unknown ones beside it.

Spaces become word marks and a piece never spans a word, as with the library's Metaspace splitting, so counts
are kept by word, in a bounded cache; a text costs a look-up for each word. Nothing is shuffled.

Vocabulary: the pieces and scores of a SentencePiece file (its path is a parameter).

Defined cases: null counts as empty, 0 pieces; any length is counted whole; equal texts count alike; an empty
table gives an empty table; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemill.llm.common import text_of

CACHE_WORDS, CACHE_CHARS = 500_000, 64
MARK = "▁"
UNKNOWN_PENALTY = 10.0


class UnigramCounter:
    """Counts pieces; vocabulary: (piece, score) in id order."""

    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool = True):
        scores = dict(vocabulary)  # of a repeated piece the last score
        self.automaton = ahocorasick.Automaton()
        for piece, score in scores.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.bytes = byte_fallback and all(f"<0x{i:02X}>" in scores for i in range(256))
        self.cache: dict[str, tuple[int, float]] = {}

    @classmethod
    def from_sentencepiece(cls, path: str) -> UnigramCounter:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return cls([(model.id_to_piece(i), model.get_score(i)) for i in range(model.vocab_size())])

    def word(self, word: str) -> tuple[int, float]:
        """(pieces, score) of the best path through one word."""
        n = len(word)
        score: list[float | None] = [0.0] + [None] * n
        count = [0] * (n + 1)
        fallen = [False] * (n + 1)  # whether the best path ends in an unknown run that counts as one piece
        at = 0
        matches = self.automaton.iter(word)
        end, match = next(matches, (n, None))
        for i in range(n):
            single = False
            best = None
            pieces, unknown = 0, False
            while end == i:
                size, own = match
                start = i + 1 - size
                candidate = own + score[start]
                if best is None or candidate > best:
                    best, pieces = candidate, count[start] + 1
                single |= size == 1
                end, match = next(matches, (n, None))
            if not single:
                candidate = self.unknown + score[i]
                if best is None or candidate > best:
                    best, unknown = candidate, not self.bytes
                    pieces = count[i] + (len(word[i].encode("utf-8", "surrogatepass")) if self.bytes else int(not fallen[i]))
            at = i + 1
            score[at], count[at], fallen[at] = best, pieces, unknown
        return count[at], score[at] or 0.0

    def count(self, text: str) -> tuple[int, float]:
        """(pieces, score) of a text."""
        if not text:
            return 0, 0.0
        marked = text.replace(" ", MARK)
        words = (marked.removeprefix(MARK)).split(MARK)
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        total, score = 0, 0.0
        for w in words:
            found = cache.get(w)
            if found is None:
                found = self.word(MARK + w)
                if len(w) <= CACHE_CHARS:
                    cache[w] = found
            total += found[0]
            score += found[1]
        return total, score


@lru_cache(maxsize=2)
def loaded(path: str) -> UnigramCounter:
    return UnigramCounter.from_sentencepiece(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def counts(text: str | Column, path: str | None = None) -> Column:
    """struct<n_tokens, score> of a text column."""
    path = path or default_path()

    def counted(column: pa.Array) -> pa.Array:
        own = loaded(path)
        rows = [own.count(x.as_py()) for x in column]
        return pa.StructArray.from_arrays([pa.array([n for n, _ in rows], type=pa.int64()), pa.array([s for _, s in rows], type=pa.float64())], names=["n_tokens", "score"])

    return F.arrow_udf(counted, "struct<n_tokens:bigint,score:double>")(text_of(text))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", counts("text").alias("c"))
    return docs.select("doc_id", F.col("c.n_tokens").alias("n_tokens"), F.col("c.score").alias("score"))
