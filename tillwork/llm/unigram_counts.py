"""Token counts of a unigram tokenizer without its tokens: Aho-Corasick matches and count-only Viterbi.

The vocabulary's pieces and scores are those of a public model file. A text is cut where the tokenizer cuts it, before
each space; a word's best segmentation is found by going through the vocabulary matches that end at each place.
Carried are the best score and its number of pieces, nothing to trace back. As in the tokenizer, a later
start replaces an earlier one only by a higher score, a character without a piece of its own costs ten more than
the worst piece, and such characters fall back to their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwork.llm.common import batches

SPACE, PENALTY = "▁", 10.0
#: Words that a worker remembers at most, and the longest of them.
CACHE, LONGEST = 300_000, 48


@lru_cache(maxsize=2)
def vocabulary(path: str) -> list[tuple[str, float]]:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.vocab_size())]


class Words(dict):
    """``word -> (pieces, score)`` with the mark of a space before the word."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.matches = ahocorasick.Automaton()
        for piece, score in pieces:
            self.matches.add_word(piece, (len(piece), score))
        self.matches.make_automaton()
        self.unknown = min((score for _, score in pieces), default=0.0) - PENALTY
        known = {piece for piece, _ in pieces}
        self.bytes = all(f"<0x{b:02X}>" in known for b in range(256))

    def best(self, word: str) -> tuple[int, float]:
        n = len(word)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for last, match in self.matches.iter(word):
            ends[last + 1].append(match)
        count, score = [0] * (n + 1), [0.0] * (n + 1)
        lost = [False] * (n + 1)  # the last piece is unknown; without bytes, such neighbours are one piece
        for end in range(1, n + 1):
            top, alone = None, False
            for length, own in sorted(ends[end], reverse=True):
                new = own + score[end - length]
                if top is None or new > top:
                    top, count[end], lost[end] = new, count[end - length] + 1, False
                alone |= length == 1
            if not alone:
                new = self.unknown + score[end - 1]
                if top is None or new > top:
                    cost = len(word[end - 1].encode("utf-8", "surrogatepass")) if self.bytes else int(not lost[end - 1])
                    top, count[end], lost[end] = new, count[end - 1] + cost, True
            score[end] = top
        return count[n], score[n]

    def __missing__(self, word: str) -> tuple[int, float]:
        found = self.best(SPACE + word)
        if len(word) <= LONGEST:
            if len(self) >= CACHE:
                self.clear()
            self[word] = found
        return found

    def text(self, text: str) -> tuple[int, float]:
        """Pieces and score of a whole text; an empty one has none."""
        if not text:
            return 0, 0.0
        words = text.replace(SPACE, " ").split(" ")
        found = list(map(self.__getitem__, words[1:] if not words[0] else words))
        return sum(n for n, _ in found), sum((s for _, s in found), 0.0)


def _count_rows(rows: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    words = Words(vocabulary(path))
    for batch in batches(rows):
        found = [words.text(t) for t in batch["text"].to_pylist()]
        yield pa.record_batch(
            [batch["doc_id"], pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())],
            names=["doc_id", "n_tokens", "score"],
        )


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, score`` for each row of ``docs(doc_id, text)``; other columns are ignored.

    A null text is empty and has no tokens. Rows that repeat, or have no id, are counted each. An empty table
    gives no rows.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        partial(_count_rows, path=path), "doc_id long, n_tokens long, score double"
    )
