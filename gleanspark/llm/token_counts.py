"""Token counts: greedy longest-match word pieces counted by a linear automaton.

The vocabulary is a trie with a root for word-initial pieces and one for continuations.  Every node has a failure link
and the number of pieces popped when it is followed, both computed once, so a word is counted in one pass over its
characters and no piece is ever built.  A word that cannot be cut counts as one unknown token.

Words are runs of anything but ``[\\x20\\x09-\\x0D]``.  Counts of words seen before come from a bounded table per worker.

Defined cases: a null or empty text has no words and no tokens; repeated rows and null ids are separate rows; an empty
table gives an empty result; a word of any length is counted in time linear in it; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from gleanspark.llm.common import pieces_of, remembered

#: Words a worker remembers before it starts anew, and bytes of text that it takes up at a time.
REMEMBERED_WORDS, PART_BYTES = 300_000, 4_000_000
_UNKNOWN = 1 << 40


def vocabulary(model_file: str) -> tuple[list[str], list[str]]:
    """Word-initial and continuing pieces of a SentencePiece model: those that begin with U+2581, and the rest."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return [p[1:] for p in pieces if p[0] == "▁" and len(p) > 1 and "▁" not in p[1:]], [p for p in pieces if "▁" not in p]


class LongestMatch:
    """The automaton: nodes 0 (words) and 1 (continuations) are the roots."""

    def __init__(self, initial: Iterable[str], following: Iterable[str]) -> None:
        self.next: list[dict[str, int]] = [{}, {}]
        ends = [False, False]
        for root, pieces in ((0, initial), (1, following)):
            for piece in pieces:
                node = root
                for c in piece:
                    node = self.next[node].setdefault(c, len(self.next))
                    if node == len(self.next):
                        self.next.append({})
                        ends.append(False)
                ends[node] = True
        self.fail = [-1] * len(self.next)
        self.popped = [0] * len(self.next)
        queue = [0, 1]
        for node in queue:
            for c, child in self.next[node].items():
                if ends[child]:
                    self.fail[child], self.popped[child] = 1, 1
                else:
                    back, n = self.fail[node], self.popped[node]
                    while back >= 0 and c not in self.next[back]:
                        n += self.popped[back]
                        back = self.fail[back]
                    if back >= 0:
                        self.fail[child], self.popped[child] = self.next[back][c], n
                queue.append(child)

    def count(self, word: str) -> int:
        """Pieces of ``word``, or 0 if it cannot be cut."""
        node = n = 0
        for c in word:
            while c not in self.next[node]:
                if self.fail[node] < 0:
                    return 0
                n += self.popped[node]
                node = self.fail[node]
            node = self.next[node][c]
        while node != 1:
            if self.fail[node] < 0:
                return 0
            n += self.popped[node]
            node = self.fail[node]
        return n


class _Counts(dict):
    """Counts by word; an unknown word is one token, marked in the high bits."""

    def __init__(self, automaton: LongestMatch) -> None:
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(word.decode()) or 1 + _UNKNOWN
        if len(word) <= 64:
            self[word] = n
        return n


def _counter(pieces, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = remembered(("counts", key), lambda: _Counts(LongestMatch(*pieces.value)))
        for batch in pieces_of(batches, PART_BYTES):
            words, tokens, unknown = [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                found = (text or b"").split()
                n = sum(map(counts.__getitem__, found))
                words.append(len(found))
                tokens.append(n % _UNKNOWN)
                unknown.append(n // _UNKNOWN)
                if len(counts) > REMEMBERED_WORDS:
                    counts.clear()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(words, pa.int64()), pa.array(tokens, pa.int64()), pa.array(unknown, pa.int64())], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return run


def token_counts(docs: DataFrame, initial: list[str], following: list[str]) -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) of every row, by greedy longest match over the given pieces."""
    spark = docs.sparkSession
    # The vocabulary's size does not depend on the data.
    shared = spark.sparkContext.broadcast((tuple(initial), tuple(following)))
    key = str(hash((tuple(initial), tuple(following))))
    return docs.select("doc_id", "text").mapInArrow(_counter(shared, key), "doc_id long, n_words long, n_tokens long, n_unknown long")
