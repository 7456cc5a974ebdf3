"""Token ids of whole texts, with words encoded once.

The tokenizer of :data:`VOCABULARY`'s kind drops white space and encodes the
words between independently of each other. So a batch is cut into words by
Arrow, each distinct word is encoded by the ``tokenizers`` library once, and the
ids of the texts are put together from those of their words. Words of plain
letters and digits are told apart from the ASCII signs behind them, which such a
tokenizer does, too. Everything else goes to the library as it stands.

A call of the library costs more than the encoding of a word, so words of letters go
there many in a text. Each is one piece, so its ids end with the one that ends a word.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tokenizers

from rolecall.llm.words import text_slices
from rolecall.llm.worker import kept

#: The vocabulary file of ``public_tokenizers`` that the queries name.
VOCABULARY = "word_bpe_49k.json"

#: Words whose ids a Python worker keeps; beyond it, it starts again.
MOST_CACHED = 600_000

#: Words handed to the library at a time; what it returns takes far more room than ids.
LEARNED = 1 << 13

#: Words of letters that are one text for the library.
JOINED = 64

#: Bytes of text encoded together.
SLICE_BYTES = 2 << 20

_PLAIN = "[A-Za-z0-9À-ÖØ-öø-ɏ]+"
_SIGNS = r"[!-/:-@\[-`{-~]*"

#: Letters that stay one letter each, whatever their case.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each (start, size), one after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


class WordEncoder:
    """Ids of texts by a tokenizer that encodes words independently."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        #: Of each id whether it ends a word; without a mark for that, none does.
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self._clear()

    def _clear(self) -> None:
        self.slots: dict[str, int] = {"": 0}
        self.pool = np.zeros(1 << 16, np.uint32)
        self.bounds = np.zeros(1 << 16, np.int64)
        self.used = 1

    def _learn(self, words: list[str]) -> None:
        for low in range(0, len(words), LEARNED):
            some = words[low:low + LEARNED]
            letters = [w for w in some if _LETTERS.fullmatch(w)]
            if len(letters) > 1 and (found := self._joined(letters)):
                self._store(letters, *found)
                some = [w for w in some if not _LETTERS.fullmatch(w)]
            if some:
                self._store(some, *self._encoded(some))

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each has."""
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.array([len(e) for e in encoded], np.int64)
        return np.fromiter(chain.from_iterable(encoded), np.uint32, int(sizes.sum())), sizes

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """As :meth:`_encoded`, of words that have one piece each; nothing, if some text
        doesn't end as many words as it was made of."""
        lows = range(0, len(words), JOINED)
        ids, sizes = self._encoded([" ".join(words[low:low + JOINED]) for low in lows])
        bounds = np.flatnonzero(self.ends[ids]) + 1
        upto = np.minimum(np.array(lows) + JOINED, len(words))
        if len(bounds) != len(words) or (bounds[upto - 1] != np.cumsum(sizes)).any():
            return None
        return ids, np.diff(bounds, prepend=0)

    def _store(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        ends = int(self.bounds[self.used - 1]) + np.cumsum(sizes)
        new = self.used + len(words)
        if new > len(self.bounds):
            self.bounds = np.concatenate([self.bounds, np.zeros(max(new, len(self.bounds)), np.int64)])
        if ends[-1] > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(int(ends[-1]), len(self.pool)), np.uint32)])
        self.pool[int(self.bounds[self.used - 1]):int(ends[-1])] = ids
        self.bounds[self.used:new] = ends
        self.slots.update(zip(words, range(self.used, new)))
        self.used = new

    def _slots(self, words: pa.Array) -> np.ndarray:
        """The slot of each word; a slot's ids end at its bound and start at the one before."""
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        found = np.fromiter(map(self.slots.get, distinct, repeat(-1)), np.int64, len(distinct))
        if len(missing := np.flatnonzero(found < 0)):
            new = [distinct[k] for k in missing.tolist()]
            self._learn(new)
            found[missing] = np.fromiter(map(self.slots.__getitem__, new), np.int64, len(new))
        return found[coded.indices.to_numpy(zero_copy_only=False)]

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, offsets) of neighbouring texts, in order; nulls are empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        for first, end, _, _ in text_slices(texts, SLICE_BYTES):
            if len(self.slots) > MOST_CACHED:
                self._clear()
            cut = pc.split_pattern(pc.replace_substring(texts.slice(first, end - first), "\n", " "), " ")
            per_text = pc.list_value_length(cut).to_numpy(zero_copy_only=False)
            words = cut.flatten().dictionary_encode()
            distinct = words.dictionary
            plain = pc.match_substring_regex(distinct, f"^{_PLAIN}{_SIGNS}$")
            signs = pc.replace_substring_regex(distinct, f"^{_PLAIN}", "")
            stem = pc.ascii_lower(pc.replace_substring_regex(distinct, f"{_SIGNS}$", ""))
            # Two parts of each distinct word, one after the other.
            parts = np.stack([self._slots(pc.if_else(plain, stem, distinct)),
                              self._slots(pc.if_else(plain, signs, ""))], 1).ravel()
            starts = self.bounds[np.maximum(parts - 1, 0)]
            sizes = np.where(parts > 0, self.bounds[parts] - starts, 0)
            ids = self.pool[ragged(starts, sizes)]
            word_sizes = sizes[0::2] + sizes[1::2]
            word_starts = np.cumsum(word_sizes) - word_sizes
            index = words.indices.to_numpy(zero_copy_only=False)
            sizes = word_sizes[index]
            ends = np.concatenate([[0], np.cumsum(sizes)])
            offsets = ends[np.concatenate([[0], np.cumsum(per_text)])]
            yield first, ids[ragged(word_starts[index], sizes)], offsets


def encoder_key(path: str) -> tuple[str, str]:
    return "encoder", path


def encoder(path: str) -> WordEncoder:
    """Loaded once in a Python worker, with the words it has met."""
    return kept(encoder_key(path), lambda: WordEncoder(path))
