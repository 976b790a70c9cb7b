"""Language ID: cross-parsing entropy against one suffix automaton per language.

A text is cut greedily into the longest phrases that occur in a language's labelled text.  With ``c`` phrases over ``n``
symbols and a reference of ``m`` symbols, ``c * log2(m) / n`` estimates the cross entropy; the language with the least wins.

Texts become bytes with case folded and everything but letters as one blank.  So that one NumPy step advances thousands of
places through all automata, texts are laid out in blocks that are first parsed as if each began a phrase.  Then every block
is parsed again from where the one before it really ended, until both parses are in one state (from there on they are the
same); blocks whose end changes hand it on.  The count is that of one parse of the whole text.

Fitting uses a bounded sample of whole texts: for each language at most ``sample_docs`` labelled documents in the order of
their id hashes, until ``sample_bytes`` bytes are reached; texts of up to an eighth of that come first, and texts beyond it
are never learned from.  Prediction reads every whole text.  The automata share one table of about 16 bytes a transition,
some 2 MB a language.

Defined cases: ``und`` with score 0 for a null text and one without letters; ties go to the language first in the alphabet;
null ids and null labels are never learned from; without labelled rows every text is ``und``; repeated rows are separate;
texts of any length are parsed whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanspark.llm.common import byte_lengths, forget, parts

SAMPLE_DOCS = 64
SAMPLE_BYTES = 32_000
#: Symbols of a block, states that are kept while blocks go through the automata together, and bytes that a worker takes up at a time.
BLOCK, KEPT_STATES, PART_BYTES = 256, 2_000_000, 1_000_000
_SPACE, _NEXT = 32, (1 << 32) - 1


def _folded() -> np.ndarray:
    fold = np.full(256, _SPACE, dtype=np.uint8)
    fold[0x80:] = np.arange(0x80, 0x100)
    fold[0x61:0x7B] = np.arange(0x61, 0x7B)
    fold[0x41:0x5B] = np.arange(0x61, 0x7B)
    return fold


_FOLD = _folded()


def normalise(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes with runs of blanks as one, and where each text begins; ``starts`` ends with the length."""
    b = _FOLD[data]
    if len(b):
        latin = np.r_[False, (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)]
        b[latin] += 0x20  # upper to lower case in Latin-1
        blank = b == _SPACE
        keep = np.r_[True, ~(blank[1:] & blank[:-1])]
        keep[starts[:-1][starts[:-1] < len(b)]] = True
    else:
        keep = np.zeros(0, dtype=bool)
    return b[keep], np.r_[0, np.cumsum(keep, dtype=np.int64)][starts]


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all substrings."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for s in symbols:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and s not in nxt[p]:
            nxt[p][s] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][s]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nxt[p].get(s) == q:
                    nxt[p][s] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return nxt


def transitions(automaton: list[dict[int, int]]) -> tuple[int, np.ndarray]:
    """The number of states, and rows of (state, symbol, next state) in the order of states: a small form of the automaton."""
    sizes = np.array([len(e) for e in automaton])
    symbols = np.fromiter((s for e in automaton for s in e), np.int32, sizes.sum())
    after = np.fromiter((to for e in automaton for to in e.values()), np.int32, sizes.sum())
    return len(automaton), np.stack([np.repeat(np.arange(len(automaton), dtype=np.int32), sizes), symbols, after], axis=1)


def packed_rows(automata: list[tuple[int, np.ndarray]], width: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The transitions of all automata in one table, rows laid into one another's gaps; and each state's place.

    The entry at ``place + symbol`` is the state's own if its upper half is that place; the lower half is the next place.
    """
    first = np.cumsum([0, *[n for n, _ in automata]])
    state = np.concatenate([rows[:, 0] + at for (_, rows), at in zip(automata, first[:-1], strict=True)]).astype(np.int64) if automata else np.zeros(0, np.int64)
    symbol_of = np.concatenate([rows[:, 1] for _, rows in automata]).astype(np.int64) if automata else state
    size = np.bincount(state, minlength=int(first[-1]))
    begin = np.cumsum(size) - size
    place = np.zeros(len(size), dtype=np.int64)
    several = np.flatnonzero(size > 1)
    cells, names, at = bytearray(4 * width), bytearray(4 * width), 0
    for i in several[np.argsort(-size[several], kind="stable")].tolist():
        symbols, p = symbol_of[begin[i] : begin[i] + size[i]].tolist(), at
        while names[p] or any(cells[p + s] for s in symbols):
            p += 1
            if p + width >= len(cells):
                cells.extend(bytes(len(cells)))
                names.extend(bytes(len(names)))
        at = max(at, p - width)
        place[i], names[p] = p, 1
        for s in symbols:
            cells[p + s] = 1
    # States of one transition take the gaps that are left.
    used, named = (np.frombuffer(x, dtype=np.uint8).astype(bool) for x in (cells, names))
    single = np.flatnonzero(size == 1)
    symbol = symbol_of[begin[single]]
    while len(single):
        gaps = np.flatnonzero(~used[width:]) + width
        if len(gaps) < len(single):
            more = np.zeros(len(single) + width, dtype=bool)
            used, named = np.r_[used, more], np.r_[named, more]
            continue
        gaps = gaps[: len(single)]
        p = gaps - symbol
        fits = np.zeros(len(p), dtype=bool)
        fits[np.unique(p, return_index=True)[1]] = True
        fits &= ~named[p]
        place[single[fits]] = p[fits]
        named[p[fits]], used[gaps[fits]] = True, True
        if not fits.any():  # none fits: the gaps that are left are no use to these symbols
            used[gaps] = True
        single, symbol = single[~fits], symbol[~fits]
    ends = np.flatnonzero(size == 0)
    place[ends] = len(used) + np.arange(len(ends))
    table = np.full(len(used) + len(ends) + width, -1, dtype=np.int64)
    places = [place[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    for own, (_, rows) in zip(places, automata, strict=True):
        table[own[rows[:, 0]] + rows[:, 1]] = (own[rows[:, 0]] << 32) | own[rows[:, 2]]
    return table, places


class Parser:
    """The automata of all languages; a state is its place in the table of transitions."""

    def __init__(self, references: dict[str, bytes]) -> None:
        self.languages = sorted(k for k, v in references.items() if v)
        raw = {k: normalise(a := np.frombuffer(references[k], np.uint8), np.array([0, len(a)]))[0] for k in self.languages}
        seen = sorted(set(b"".join(r.tobytes() for r in raw.values())))
        self.code = np.full(256, len(seen), dtype=np.int32)
        self.code[seen] = np.arange(len(seen))
        width = len(seen) + 1
        # The last state of each stands between phrases: at the start, and after a symbol that the language never has.
        automata = [transitions([*suffix_automaton(self.code[raw[k]].tolist()), {}]) for k in self.languages]
        self.table, places = packed_rows(automata, width)
        self.between = np.array([p[-1] for p in places], dtype=np.int64)
        #: Where the first symbol of a phrase leads.
        self.first = np.repeat(self.between[:, None], width, axis=1)
        for row, p, (_, rows) in zip(self.first, places, automata, strict=True):
            root = rows[rows[:, 0] == 0]
            row[root[:, 1]] = p[root[:, 2]]
        self.bits = np.array([math.log2(max(2, len(raw[k]))) for k in self.languages])

    def _blocks(self, symbols: np.ndarray, sizes: np.ndarray, follows: np.ndarray, carried: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that begin in each block, by language, and the last block's end.

        ``symbols`` has a column for each block, longest first; ``follows`` is the column that a block comes after (-1 for
        none), and ``carried`` the states that blocks without one begin with.
        """
        steps, n_lang = int(sizes[0]), len(self.languages)
        states = np.zeros((steps, n_lang, len(sizes)), dtype=np.int32)
        counts = np.zeros((steps, n_lang, len(sizes)), dtype=np.int16)
        state, count = carried.copy(), np.zeros(carried.shape, dtype=np.int32)
        for t in range(steps):
            live = int(np.searchsorted(-sizes, -t))
            before, column = state[:, :live], symbols[t, :live]
            entry = self.table.take(before + column)
            new = (entry >> 32) != before
            state[:, :live] = np.where(new, self.first.take(column, axis=1), entry & _NEXT)
            count[:, :live] += new
            states[t, :, :live], counts[t, :, :live] = state[:, :live], count[:, :live]
        plain_end, end, more = state, state.copy(), np.zeros_like(count)
        after = np.full(len(sizes), -1)
        after[follows[follows >= 0]] = np.flatnonzero(follows >= 0)
        again = np.zeros(state.shape, dtype=bool)
        again[:, follows >= 0] = True
        while again.any():
            lang, lane = np.nonzero(again)
            begun, n, t, changed = end[lang, follows[lane]], np.zeros(len(lane), dtype=np.int32), 0, []
            while len(lane):
                column = symbols[t, lane]
                entry = self.table.take(begun + column)
                new = (entry >> 32) != begun
                begun = np.where(new, self.first[lang, column], entry & _NEXT)
                n += new
                met = begun == states[t, lang, lane]
                stop = met | (sizes[lane] == t + 1)
                if stop.any():
                    k, j = lang[stop], lane[stop]
                    more[k, j] = n[stop] - counts[t, k, j]
                    changed.append((k, j, np.where(met[stop], plain_end[k, j], begun[stop])))
                    go = ~stop
                    lang, lane, begun, n = lang[go], lane[go], begun[go], n[go]
                t += 1
            again[:] = False
            for k, j, to in changed:
                other = (to != end[k, j]) & (after[j] >= 0)
                end[k, j] = to
                again[k[other], after[j[other]]] = True
        return count + more, end

    def phrases(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases by text and language, and symbols by text."""
        folded, starts = normalise(data, starts)
        codes = self.code[folded]
        sizes = np.diff(starts)
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(sizes)), blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = starts[:-1][owner] + nth * BLOCK
        size = np.minimum(BLOCK, sizes[owner] - nth * BLOCK)
        total = np.zeros((len(sizes), len(self.languages)), dtype=np.int64)
        lanes = max(64, KEPT_STATES // (BLOCK * max(1, len(self.languages))))
        end = self.between
        for i in range(0, len(owner), lanes):
            order = np.argsort(-size[i : i + lanes], kind="stable")
            at, n, nth_ = (x[i : i + lanes][order] for x in (begin, size, nth))
            place = np.empty(len(order), dtype=np.int64)
            place[order] = np.arange(len(order))
            symbols = codes[np.minimum(np.arange(int(n[0]))[:, None] + at[None, :], len(codes) - 1)]
            follows = np.where((order > 0) & (nth_ > 0), place[order - 1], -1)
            carried = np.repeat(self.between[:, None], len(order), axis=1)
            if nth[i] > 0:  # the text of the blocks before goes on
                carried[:, place[0]] = end
            count, ends = self._blocks(symbols, n, follows, carried)
            end = ends[:, place[-1]]
            np.add.at(total, owner[i : i + lanes][order], count.T)
        return total, sizes

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        texts = texts.cast(pa.large_binary())
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        lang, score = ["und"] * n, np.zeros(n)
        if not self.languages or not n:
            return lang, score
        total, sizes = self.phrases(data, offsets - offsets[0])
        entropy = total * self.bits / np.maximum(sizes, 1)[:, None]
        order = np.argsort(entropy, axis=1, kind="stable")
        best = entropy[np.arange(n), order[:, 0]]
        second = entropy[np.arange(n), order[:, 1]] if len(self.languages) > 1 else np.full(n, np.inf)
        score = np.where(second > 0, 1 - best / second, 0.0)
        letters = np.r_[0, np.cumsum((_FOLD[data] != _SPACE) & (data < 0x80))][offsets - offsets[0]]
        for i in range(n):
            plain = letters[i + 1] > letters[i]
            if plain or any(c.isalpha() for c in data[offsets[i] - offsets[0] : offsets[i + 1] - offsets[0]].tobytes().decode("utf-8", "ignore")):
                lang[i] = self.languages[order[i, 0]]
            else:
                score[i] = 0.0
        return lang, score


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> dict[str, bytes]:
    """Labelled text by language, from rows that are not held out: whole texts up to the bounds of the sample."""
    size = F.octet_length("text")
    labelled = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.coalesce(size, F.lit(0)) > 0) & (size <= sample_bytes) & ~held_out(F.col("doc_id")))
    by_hash = Window.partitionBy("lang").orderBy(F.col("size") > sample_bytes // 8, F.xxhash64("doc_id"), "doc_id", "size")
    # At most sample_docs rows a language go on.
    first = labelled.select("doc_id", "lang", size.alias("size")).withColumn("n", F.row_number().over(by_hash)).where(F.col("n") <= sample_docs)
    before = F.sum("size").over(Window.partitionBy("lang").orderBy("n")) - F.col("size")
    ids = first.withColumn("before", before).where((F.col("before") + F.col("size") <= sample_bytes) | (F.col("n") == 1))
    chosen = sorted({r.doc_id for r in ids.select("doc_id").collect()})
    rows = labelled.where(F.col("doc_id").isin(chosen)).select("lang", "doc_id", "text").collect() if chosen else []
    parts: dict[str, list[bytes]] = {}
    for lang, _, text in sorted({(r.lang, r.doc_id, r.text) for r in rows}):
        parts.setdefault(lang, []).append(text.encode())
    return {lang: b"\n".join(p) for lang, p in parts.items()}


def found_language(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> Column:
    """A column of the language and score of ``text``, fitted on ``docs``.

    The automata are built once, on the bounded sample, and sent to the workers as one table; only texts go to Python.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Parser(fit(docs, sample_docs, sample_bytes)))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        forget()
        for texts in batches:
            langs, scores = [], []
            for part in parts(pa.RecordBatch.from_arrays([texts], names=["text"]), byte_lengths(texts), PART_BYTES):
                lang, score = shared.value.predict(part.column("text"))
                langs += lang
                scores.append(score)
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate([*scores, np.zeros(0)]))], names=["lang_pred", "score"])

    return F.arrow_udf(run, "lang_pred string, score double", F.ArrowUDFType.SCALAR_ITER)(F.col("text").cast("string"))


def language_id(docs: DataFrame, keep: list[str] | None = None, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """The columns ``keep`` of ``docs`` (doc_id by default) with lang_pred and score (0: a tie, to 1)."""
    keep = [k for k in keep or ["doc_id"] if k not in ("lang_pred", "score")]
    # Numbered names inside, so that no column of docs clashes with the result's.
    found = docs.select(*[F.col(f"`{k}`").alias(f"c{i}") for i, k in enumerate(keep)], found_language(docs, sample_docs, sample_bytes).alias("found"))
    return found.select(*[F.col(f"c{i}").alias(k) for i, k in enumerate(keep)], "found.lang_pred", "found.score")


def identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, as they are, whose language is found."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), found_language(docs)["lang_pred"].alias("found"))
    return rows.where("found <> 'und'").select("row.*")
