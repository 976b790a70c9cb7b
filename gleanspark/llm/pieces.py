"""SentencePiece encoding and decoding as a weighted finite-state transducer.

What is compiled from a model is the transducer of its pieces: a trie that returns to its root with a piece's id.  The other
two parts have one state each and are applied rather than compiled: the normaliser (a blank in front of the text, blanks
written as U+2581) as replacements, and the byte fallback (a character becomes its UTF-8 bytes' pieces) as an arc that is
there where no piece begins.  They are composed with an input as the path is followed.

Weights: pieces of a unigram model weigh their negated score, and the path of least total weight over the tropical semiring
is found by relaxing positions in order.  For a BPE model an arc from piece ``a`` to piece ``b`` has weight 0 where the
model, applied to the two together, gives just ``a, b``, and infinity elsewhere; such weights are found when first asked for
and remembered.  All finite paths then weigh 0 and every prefix of an input has one, so nothing is relaxed: the path is
followed depth first over open arcs, and a position that can't be left is never entered again.

A text is composed in segments that no piece crosses (before a blank that follows something else, and around line ends);
segments seen before come from a bounded table per worker.

Decoding writes the pieces' bytes, blanks for U+2581, and drops the blank in front.  U+2581 itself in a text is encoded
through the byte fallback, so that decoding gives back every text exactly.

Defined cases: a null or empty text has no pieces and decodes to the empty text; repeated rows and null ids are separate
rows; texts of any length are encoded whole; of BPE joins equally good the leftmost comes first; an empty table gives an empty result; other columns are passed on only where
named, and a column of the result's name that was there before is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from gleanspark.llm.common import parts, pieces_of, remembered

BLANK = "▁"
#: A private character that stands for U+2581 inside the transducer.
STAND_IN = "\ue000"
#: What a worker remembers before it starts anew.
REMEMBERED_SEGMENTS = 160_000
REMEMBERED_ARCS = 250_000
#: Bytes of text, or ids, that a worker takes up at a time.
PART_BYTES, PART_IDS = 2_000_000, 500_000
_SEGMENT = re.compile(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n+")


@dataclass(frozen=True)
class Model:
    """A tokenizer's tables: pieces by id (None for control), scores, the ids of the bytes, and whether it is BPE."""

    pieces: tuple[str | None, ...]
    scores: tuple[float, ...]
    bytes_: tuple[int, ...]
    bpe: bool = True


def load(model_file: str, bpe: bool = True) -> Model:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = m.get_piece_size()
    special = [m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i) for i in range(n)]
    return Model(
        tuple(None if special[i] else m.id_to_piece(i) for i in range(n)),
        tuple(m.get_score(i) for i in range(n)),
        tuple(m.piece_to_id(f"<0x{b:02X}>") for b in range(256)),
        bpe,
    )


def merges(symbols: str, ids: dict[str, int], scores: tuple[float, ...]) -> list[tuple[str, int, int]]:
    """How the model joins a short string: (piece, start, split) of every join in order, the split's place in the string.

    The best-scored neighbours join first, leftmost first among equals.
    """
    ends = list(range(1, len(symbols) + 1))
    starts = list(range(len(symbols)))
    joined = []
    while len(starts) > 1:
        found = [(-scores[ids[p]], k) for k in range(len(starts) - 1) if (p := symbols[starts[k] : ends[k + 1]]) in ids]
        if not found:
            break
        k = min(found)[1]
        joined.append((symbols[starts[k] : ends[k + 1]], starts[k], ends[k]))
        ends[k] = ends.pop(k + 1)
        starts.pop(k + 1)
    return joined


class Transducer:
    """Compiled from a model; ``encode`` composes it with a normalised segment.

    The BPE arcs come from lifetimes: while a model joins the characters of ``a`` and ``b``, a part at the inner edge of
    either lives from the join that makes it to the join that takes it up.  The arc from ``a`` to ``b`` is closed if two
    such parts live at one time and make a piece that would be joined before either is taken up.
    """

    def __init__(self, model: Model) -> None:
        self.model = model
        self.ids = {p: i for i, p in enumerate(model.pieces) if p is not None}
        self.trie: dict = {}
        for piece, i in self.ids.items():
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[None] = i
        self.arcs: dict[int, bool] = {}
        self.edges: dict[int, tuple[list, list] | None] = {}
        if any(BLANK in p.lstrip(BLANK) for p in self.ids) or any("\n" in p for p in self.ids):
            raise ValueError("a piece crosses the bounds of segments")

    def edge_parts(self, piece: int) -> tuple[list, list] | None:
        """(part, from, to) at the left and at the right edge of a piece; None if the model cuts the piece itself."""
        if piece not in self.edges:
            text, scores = self.model.pieces[piece], self.model.scores
            joined = merges(text, self.ids, scores)
            born = {(i, i + 1): float("-inf") for i in range(len(text))}
            dies, now = {}, float("-inf")
            for part, start, split in joined:
                now = max(now, -scores[self.ids[part]])
                born[start, start + len(part)] = now
                dies[start, split] = dies[split, start + len(part)] = now
            whole = (0, len(text)) in born
            sides = ([], [])
            for (i, j), since in born.items():
                for edge, side in ((i == 0, sides[0]), (j == len(text), sides[1])):
                    if edge:
                        side.append((text[i:j], since, dies.get((i, j), float("inf"))))
            self.edges[piece] = sides if whole else None
        return self.edges[piece]

    def arc(self, a: int, b: int) -> bool:
        """Whether ``b`` may follow ``a``; fallback characters (negative) go with anything."""
        if a < 0:
            return self.edge_parts(b) is not None
        key = (a << 32) + b
        known = self.arcs.get(key)
        if known is None:
            known = self._open(a, b)
            if len(self.arcs) > REMEMBERED_ARCS:
                self.arcs.clear()
            self.arcs[key] = known
        return known

    def _open(self, a: int, b: int) -> bool:
        ids, scores = self.ids, self.model.scores
        x, y = self.edge_parts(a), self.edge_parts(b)
        if x is None or y is None:
            return False
        for left, since_l, to_l in x[1]:
            for right, since_r, to_r in y[0]:
                i = ids.get(left + right)
                if i is not None and max(since_l, since_r) < min(to_l, to_r) and -scores[i] < to_l and -scores[i] <= to_r:
                    return False
        return True

    def encode(self, segment: str) -> list[int]:
        """Ids on the path of least weight."""
        path = self._bpe(segment) if self.model.bpe else self._unigram(segment)
        out: list[int] = []
        i = 0
        for piece, j in path:
            if piece >= 0:
                out.append(piece)
            else:
                out.extend(self.model.bytes_[b] for b in segment[i:j].replace(STAND_IN, BLANK).encode())
            i = j
        return out

    def _bpe(self, segment: str) -> list[tuple[int, int]]:
        """Weights are 0 and infinite: any path of open arcs is the least.  Longer pieces are followed first.

        A position that can't be left over open arcs is never entered again, so the time is linear.
        """
        n, trie, arc = len(segment), self.trie, self.arc
        path: list[tuple[int, int]] = []
        untried: list[list[tuple[int, int]]] = []
        dead: set[int] = set()
        i, last, here = 0, -1, None
        while i < n:
            if here is None:
                here, node, j = [], trie, i
                while j < n and (node := node.get(segment[j])) is not None:
                    j += 1
                    if None in node:
                        here.append((node[None], j))
                if not here:
                    here.append((-1, i + 1))
            while here:
                piece, j = here.pop()
                if (not dead or j not in dead) and (piece < 0 or arc(last, piece)):
                    path.append((piece, j))
                    untried.append(here)
                    i, last, here = j, piece, None
                    break
            else:
                dead.add(i)
                path.pop()
                here = untried.pop()
                last, i = path[-1] if path else (-1, 0)
        return path

    def _unigram(self, segment: str) -> list[tuple[int, int]]:
        n, scores = len(segment), self.model.scores
        low = min(scores) - 10.0
        cost, last, back = [0.0] + [float("inf")] * n, [-1] * (n + 1), [0] * (n + 1)
        for i in range(n):
            if cost[i] - low < cost[i + 1]:
                cost[i + 1], last[i + 1], back[i + 1] = cost[i] - low, -1, i
            node, j = self.trie, i
            while j < n and (node := node.get(segment[j])) is not None:
                j += 1
                if None in node and cost[i] - scores[node[None]] < cost[j]:
                    cost[j], last[j], back[j] = cost[i] - scores[node[None]], node[None], i
        return self._path(last, back)

    @staticmethod
    def _path(last: list[int], back: list[int]) -> list[tuple[int, int]]:
        path, j = [], len(last) - 1
        while j > 0:
            path.append((last[j], j))
            j = back[j]
        return path[::-1]


class _Segments(dict):
    def __init__(self, transducer: Transducer) -> None:
        super().__init__()
        self.transducer = transducer

    def __missing__(self, segment: str) -> bytes:
        out = np.array(self.transducer.encode(segment), dtype=np.int32).tobytes()
        if len(segment) <= 64:
            self[segment] = out
        return out


def normalise(text: str) -> str:
    """A blank in front, U+2581 for blanks; U+2581 in the text becomes its stand-in."""
    return BLANK + text.replace(BLANK, STAND_IN).replace(" ", BLANK)


def encode_text(text: str, segments: _Segments) -> bytes:
    """Ids of a text as little-endian 32-bit integers."""
    if not text:
        return b""
    if STAND_IN in text:  # the private character itself: encode around it, its bytes between
        bytes_, parts = segments.transducer.model.bytes_, text.split(STAND_IN)
        own = np.array([bytes_[b] for b in STAND_IN.encode()], dtype=np.int32).tobytes()
        return own.join([_encoded(normalise(parts[0]), segments), *(_encoded(normalise(p)[1:], segments) for p in parts[1:])])
    return _encoded(normalise(text), segments)


def _encoded(normal: str, segments: _Segments) -> bytes:
    return b"".join(map(segments.__getitem__, _SEGMENT.findall(normal)))


def surfaces(model: Model) -> list[bytes]:
    """What each id decodes to, before the blank in front is dropped."""
    out = [b"" if p is None else p.replace(BLANK, " ").encode() for p in model.pieces]
    for b, i in enumerate(model.bytes_):
        out[i] = bytes([b])
    return out


def decode_ids(ids: np.ndarray, table: list[bytes]) -> str:
    data = b"".join(map(table.__getitem__, ids.tolist()))
    return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


def _segments(model: Model) -> _Segments:
    return remembered(("pieces", hash(model)), lambda: _Segments(Transducer(model)))


def _encode_batch(batch: pa.RecordBatch, segments: _Segments) -> pa.ListArray:
    encoded, ends = [], [0]
    for text in batch.column("text").to_pylist():
        encoded.append(encode_text(text or "", segments))
        ends.append(ends[-1] + len(encoded[-1]) // 4)
        if len(segments) > REMEMBERED_SEGMENTS:
            segments.clear()
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(encoded), np.int32)))


def _decode_column(column: pa.ListArray, table: list[bytes]) -> pa.Array:
    return pa.array([decode_ids(column[i].values.to_numpy(), table) if column[i].is_valid else "" for i in range(len(column))], pa.string())


def _encoder(shared, keep: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = _segments(shared.value)
        for batch in pieces_of(batches, PART_BYTES):
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), _encode_batch(batch, segments)], names=[*keep, "ids"])

    return run


def _id_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pa.compute.list_value_length(batch.column("ids")).fill_null(0).to_numpy(zero_copy_only=False)
        yield from parts(batch, sizes, PART_IDS)


def _decoder(shared, keep: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = surfaces(shared.value)
        for batch in _id_parts(batches):
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), _decode_column(batch.column("ids"), table)], names=[*keep, "decoded"])

    return run


def _both(shared, keep: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments, table = _segments(shared.value), surfaces(shared.value)
        for batch in pieces_of(batches, PART_BYTES):
            ids = _encode_batch(batch, segments)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), ids, _decode_column(ids, table)], names=[*keep, "ids", "decoded"])

    return run


def _schema(df: DataFrame, keep: list[str], more: str) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), more])


def encode(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (doc_id by default) and ``ids``, the encoding of ``text``."""
    keep = [k for k in (keep or ["doc_id"]) if k != "ids"]
    # A model's size does not depend on the data.
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(_encoder(shared, keep), _schema(docs, keep, "ids array<int>"))


def decode(encoded: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` and ``decoded``, the text that ``ids`` stand for."""
    keep = [k for k in (keep or ["doc_id"]) if k != "decoded"]
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    return encoded.select(*dict.fromkeys([*keep, "ids"])).mapInArrow(_decoder(shared, keep), _schema(encoded, keep, "decoded string"))


def encode_and_decode(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep``, ``ids`` and ``decoded``: what ``decode`` makes of ``encode``, in one Python worker a task."""
    keep = [k for k in (keep or ["doc_id"]) if k not in ("ids", "decoded")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(_both(shared, keep), _schema(docs, keep, "ids array<int>, decoded string"))
