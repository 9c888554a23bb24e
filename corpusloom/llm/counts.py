"""Token counts by a count-only Viterbi over a unigram vocabulary.

Aho-Corasick gives every vocabulary match that ends at a character, the longest first; dynamic programming carries the
best score and its number of pieces, no path. Tie rules are the tokenizer's: scores add up as doubles, a later
candidate must be strictly better, and candidates for an end come in the order of their starts. A character that no
piece of its own covers may be unknown, at the least score less 10, and counts as its bytes.

The vocabulary is that of piece_bpe_32k.model, the only one at hand with a score for each piece; its scores are taken for
unigram scores, any other of (piece, score) will do.

Words are separated at spaces, the space going with the next word, so each distinct word is counted once in a task.

Defined cases: null counts as empty, an empty text has no tokens; the vocabulary's mark for a space, U+2581, in a text
reads as a space, as the tokenizer has it; rows that repeat count alike; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import small_batches
from corpusloom.llm.pieces import MODEL, SPACE, read_model

UNKNOWN_PENALTY = 10.0
#: Distinct words whose counts a task remembers; it starts anew beyond that.
REMEMBERED = 400_000
WORD = re.compile(f"{SPACE}[^{SPACE}]*")


class Counter:
    """Token counts with one vocabulary of (piece, score)."""

    def __init__(self, vocabulary: list[tuple[str, float]]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.known: dict[str, int] = {}

    def word(self, text: str) -> int:
        """Pieces of the best segmentation."""
        n = len(text)
        best: list[float | None] = [0.0] + [None] * n
        count = [0] * (n + 1)
        single = [False] * n
        done = 0  # ends up to here have got their unknown candidate
        for end, (size, score) in self.automaton.iter(text):
            end += 1
            while done < end - 1:
                done += 1
                if not single[done - 1]:
                    self._unknown(text, best, count, done)
            start = end - size
            if best[start] is not None:
                found = best[start] + score
                if best[end] is None or found > best[end]:
                    best[end], count[end] = found, count[start] + 1
            if size == 1:
                single[start] = True
        while done < n:
            done += 1
            if not single[done - 1]:
                self._unknown(text, best, count, done)
        return count[n]

    def _unknown(self, text: str, best: list, count: list[int], end: int) -> None:
        """The candidate of one unknown character: the last of its end, as it starts last."""
        found = best[end - 1] + self.unknown
        if best[end] is None or found > best[end]:
            best[end], count[end] = found, count[end - 1] + len(text[end - 1].encode("utf-8", "surrogatepass"))

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        known, total = self.known, 0
        if len(known) > REMEMBERED:
            known.clear()
        marked = text.replace(" ", SPACE)
        for w in WORD.findall(marked if marked[0] == SPACE else SPACE + marked):
            k = known.get(w)
            if k is None:
                k = self.word(w)
                if len(w) <= 64:
                    known[w] = k
            total += k
        return total


def token_counts(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, n_chars (code points), n_tokens for each row of docs."""
    small_batches(docs.sparkSession)
    vocabulary = docs.sparkSession.sparkContext.broadcast([p for p in read_model(path)["pieces"] if p])
    shape = T.StructType([docs.schema["doc_id"], T.StructField("n_chars", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t or "") for t in texts], pa.int64()), pa.array([counter.text(t) for t in texts], pa.int64())], names=shape.fieldNames())

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(rows, shape)
