"""Language of a text by cross-parsing entropy.

Per language a suffix automaton of sample text is built. A text is parsed with
each: the longest run of letters that occurs in the sample is a phrase, and the
next phrase starts behind it. A text of n bytes that needs c phrases from a
sample of m bytes takes c * log2(m) / n bits a byte; the language that needs the
fewest wins.
"""

from __future__ import annotations

import regex
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rolecall.llm.worker import dropped, kept, lean, only

#: Bounds of the sample a language is learned from: rows, and bytes of each.
SAMPLE_ROWS, SAMPLE_BYTES = 128, 384

#: A text is parsed in pieces of so many bytes, all bytes of it; a phrase ends
#: where a piece does. Pieces are worked on side by side, so many at most.
PIECE, LANES = 1024, 8192

UNKNOWN = "und"

#: Marks stay with their letters; number signs are none.
_NOT_LETTERS, _LETTER = regex.compile(r"[^\p{L}\p{M}]+"), regex.compile(r"\p{L}")


def letters(text: str | None) -> bytes:
    """Lower-case letters, with one space for what is between them; nothing without a letter."""
    read = _NOT_LETTERS.sub(" ", text or "").strip().lower()
    return read.encode() if _LETTER.search(read) else b""


class Automaton:
    """All substrings of a sample as a table of transitions.

    ``table[state + symbol]`` is four times the next state, plus the phrases that
    end there: one if the run does not go on in the sample, and one for a byte that
    the sample lacks. Symbol 0 is padding and stays in place; symbol 1 is any byte
    no sample holds.
    """

    def __init__(self, sample: bytes, symbols: np.ndarray, width: int):
        follow, link, length = [{}], [-1], [0]
        last = 0
        for byte in sample:
            c = int(symbols[byte])
            new = len(follow)
            follow.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in follow[p]:
                follow[p][c] = new
                p = link[p]
            if p >= 0:
                q = follow[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    copy = len(follow)
                    follow.append(dict(follow[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    link[q] = link[new] = copy
                    while p >= 0 and follow[p].get(c) == q:
                        follow[p][c] = copy
                        p = link[p]
            last = new
        table = np.empty((len(follow), width), np.int32)
        start = np.zeros(width, np.int32)
        for c, q in follow[0].items():
            start[c] = q
        table[:] = 4 * width * start + np.where(start > 0, 1, 2)
        for state, edges in enumerate(follow):
            for c, q in edges.items():
                table[state, c] = 4 * width * q
        # At the start nothing has been read, so no phrase ends before a byte.
        table[0, :] = 4 * width * start + (start == 0)
        table[:, 0] = 4 * width * np.arange(len(follow))
        self.table = table.ravel()


class LanguageModel:
    """The samples of all languages, ready to parse batches of texts."""

    def __init__(self, samples: dict[str, bytes]):
        self.languages = sorted(samples)
        seen = np.zeros(256, bool)
        for sample in samples.values():
            seen[np.frombuffer(sample, np.uint8)] = True
        self.symbols = np.ones(256, np.int32)
        self.symbols[seen] = np.arange(2, 2 + int(seen.sum()))
        width = 2 + int(seen.sum())
        # All automata stand in one table, one after the other.
        tables = [Automaton(samples[language], self.symbols, width).table for language in self.languages]
        ends = np.cumsum([0, *map(len, tables)])
        self.bases = ends[:-1].tolist()
        self.table = np.empty(int(ends[-1]), np.int32 if ends[-1] < 1 << 29 else np.int64)
        for base in reversed(self.bases):
            table = tables.pop()
            part = self.table[base:base + len(table)]
            part[:] = table
            part += 4 * base
        self.cost = np.log2([max(2, len(samples[x])) for x in self.languages])

    def _phrases(self, pieces: np.ndarray) -> np.ndarray:
        """Phrases of each piece (rows) by language (columns)."""
        width = pieces.shape[1]
        bases = np.array(self.bases, self.table.dtype)[:, None]
        state = np.repeat(4 * bases, width, axis=1)
        count = np.zeros(state.shape, np.int32)
        at = np.empty_like(state)
        for symbols in pieces:
            np.right_shift(state, 2, out=at)
            at += symbols
            np.take(self.table, at, out=state, mode="clip")
            count += state & 3
        # What is left when a piece ends is a phrase, too.
        count += (state >> 2) != bases
        return count.T

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and bits a byte of each text."""
        read = [letters(t) for t in texts]
        sizes = np.array([len(r) for r in read])
        phrases = np.zeros((len(texts), len(self.languages)), np.int64)
        if self.languages:
            starts = [(row, at) for row, r in enumerate(read) for at in range(0, len(r), PIECE)]
            # Pieces of similar length together: little padding.
            starts.sort(key=lambda p: min(PIECE, sizes[p[0]] - p[1]))
            for low in range(0, len(starts), LANES):
                part = starts[low:low + LANES]
                longest = min(PIECE, sizes[part[-1][0]] - part[-1][1])
                lanes = np.zeros((len(part), longest), self.symbols.dtype)
                for lane, (row, at) in enumerate(part):
                    raw = np.frombuffer(read[row], np.uint8, min(PIECE, sizes[row] - at), at)
                    lanes[lane, :len(raw)] = self.symbols[raw]
                np.add.at(phrases, [row for row, _ in part],
                          self._phrases(np.ascontiguousarray(lanes.T)))
        names, scores, bits = [], np.zeros(len(texts)), np.zeros(len(texts))
        for row, size in enumerate(sizes):
            if not size or not self.languages:
                names.append(UNKNOWN)
                continue
            needed = phrases[row] * self.cost
            order = np.argsort(needed, kind="stable")
            names.append(self.languages[order[0]])
            bits[row] = needed[order[0]] / size
            second = needed[order[1]] if len(order) > 1 else 2 * needed[order[0]]
            scores[row] = 1 - needed[order[0]] / second if second else 0.0
        return names, scores, bits


def learn(labelled: DataFrame, rows: int = SAMPLE_ROWS, most: int = SAMPLE_BYTES) -> dict[str, bytes]:
    """A sample of each language of ``labelled`` (text, lang), for :class:`LanguageModel`.

    Rows are picked by the hash of their text, ``rows`` of each language, and
    ``most`` bytes are taken from the middle of each, so the sample has a fixed
    bound: about twice ``rows`` pass the threshold of their language, and copies
    count once. Rows without a language, or without text, teach nothing.
    """
    usable = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
                             ).where("text is not null and lang is not null")
    picked = F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1))
    # Different texts are counted: of a language of copies no smaller sample is taken.
    different = usable.select("lang", picked.alias("picked")).distinct()
    counts = {r.lang: r.n for r in different.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    # Hash thresholds that some twice as many texts pass as are taken; of the few, all.
    bounds = {lang: min(1 << 62, int((1 << 62) * 2 * rows / n)) for lang, n in counts.items()}
    if not bounds:
        return {}
    limits = F.create_map(*[F.lit(x) for pair in bounds.items() for x in pair])
    middle = F.greatest(F.lit(1), F.floor(F.length("text") / 2).cast("int") - most // 2)
    found = usable.select("lang", picked.alias("picked"), F.substring("text", middle, F.lit(most)).alias("part")).where(
        F.col("picked") <= F.try_element_at(limits, "lang")).distinct().orderBy("lang", "picked", "part")
    parts: dict[str, list[bytes]] = {lang: [] for lang in bounds}
    for row in found.collect():
        if len(parts[row.lang]) < rows:
            parts[row.lang].append(letters(row.part)[:most])
    return {lang: b" ".join(p) for lang, p in parts.items() if any(p)}


def identify(documents: DataFrame, samples: dict[str, bytes]) -> DataFrame:
    """``documents`` with ``lang_pred``, ``lang_score`` and ``lang_bits``.

    Only ``text`` is looked at, all of it. A text that is null or holds no letter
    is ``und`` with a score of 0; so is every text if there are no samples. The
    score is the share of bits the winner saves against the second: 0 for a tie,
    which the first language in order wins. Columns of these names are replaced.
    """
    sent = tuple(sorted(samples.items()))
    key = ("languages", sent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = kept(key, lambda: LanguageModel(dict(sent)))
        try:
            for batch in batches:
                for low in range(0, batch.num_rows, 1000):
                    part = batch.slice(low, 1000)
                    names, scores, bits = model.predict(part.column("text").to_pylist())
                    same = [part.column(c) for c in keep]
                    yield pa.record_batch([*same, pa.array(names, pa.string()), pa.array(scores), pa.array(bits)],
                                          names=[*keep, "lang_pred", "lang_score", "lang_bits"])
        finally:
            # Its tables are large; the worker goes on to other stages.
            dropped(key)

    added = ("lang_pred", "lang_score", "lang_bits")
    base = documents.drop(*added)
    keep = base.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema]
                       + ["lang_pred string", "lang_score double", "lang_bits double"])
    return base.mapInArrow(lean(only(run, key)), schema)
