"""Token ids of whole texts, put together from those of distinct words, which a bounded cache keeps.

The vocabularies meant here (BPE with word ends) cut a text at white space and
between letters, digits and other signs before merging, so the ids of a text are
those of its words in order. Words repeat a lot, more than the pieces between white
space, which hold signs and capitals as well. A share of the texts is split into pieces, Arrow numbers
these, cuts the distinct ones into words and finds the words' places in the cache; only
words that are not there go through Python and are merged, by the tokenizer's model. The ids
of all pieces, and then of all texts, are gathered in one step each. That short cut is taken only for pieces of
printable ASCII and Latin-1 letters, where normalising is plain lowering; any other
piece is taken whole and left to the tokenizer itself. The ids always equal those of
encoding the whole text.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MAX_CACHED = 200_000  # words that a Python worker keeps with their ids, some 10 MB; beyond it the half met last stays
LONGEST_CACHED = 64  # bytes of a word that is kept
SHARE = 2_000_000  # characters that are split at once; what a Python worker needs beside its texts grows with it

_SAFE = "^[!-~À-ÖØ-öø-ÿ]+$"
_WORD = "'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+"
_LOADED: dict[str, WordEncoder] = {}


class WordEncoder:
    """Encodes texts to little-endian unsigned ids of two bytes, or four if the vocabulary needs them (``dtype``)."""

    def __init__(self, vocabulary: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_str(vocabulary)
        parts = json.loads(vocabulary)
        greatest = max([*parts["model"]["vocab"].values(), *(token["id"] for token in parts.get("added_tokens") or [])])
        self.dtype = np.dtype("<u2" if greatest < 1 << 16 else "<u4")
        self.model = self.tokenizer.model
        self.has_ends = bool(parts["model"].get("end_of_word_suffix"))
        # How the model spells letters beyond ASCII.
        to_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelling = {code: to_bytes.pre_tokenize_str(chr(code))[0][0] for code in range(0xC0, 0x100)}
        # Words met lately, the ids of all after each other, how many each has, and the share that had it last.
        self.known = pa.array([], pa.large_string())
        self.ids, self.sizes, self.met = np.empty(0, self.dtype), np.empty(0, np.int64), np.empty(0, np.int64)
        self.shares = 0

    @classmethod
    def of(cls, vocabulary: str) -> WordEncoder:
        """The encoder of this worker for a vocabulary file's content."""
        key = hashlib.sha256(vocabulary.encode()).hexdigest()
        if key not in _LOADED:
            _LOADED[key] = cls(vocabulary)
        return _LOADED[key]

    def _gathered(self, sizes: np.ndarray, ids: np.ndarray, numbers: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lists of things, and where each list's begin and end: ``ids`` of all things after each other, ``numbers`` of the things of all lists, and where lists start."""
        starts, lengths = np.cumsum(sizes) - sizes, sizes[numbers]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        # The id at each place of the output is that many behind the start of its thing's ids.
        places = np.arange(ends[-1])
        places += np.repeat(starts[numbers] - ends[:-1], lengths)
        return ids[places], ends[offsets]

    def _is_plain(self, column: pa.Array) -> pa.Array:
        plain = pc.and_not(pc.match_substring_regex(column, _SAFE), pc.match_substring(column, "<|"))
        return plain if self.has_ends else pc.and_(plain, False)

    def _words(self, pieces: pa.Array) -> pa.Array:
        """The words of each piece; one that is not plain is a word of its own."""
        plain = self._is_plain(pieces)
        pieces = pc.replace_with_mask(pieces, plain, pc.utf8_lower(pieces.filter(plain)))
        mixed = pc.and_not(plain, pc.utf8_is_alpha(pieces))
        apart = pc.utf8_rtrim(pc.replace_substring_regex(pieces.filter(mixed), _WORD, r"\0 "), " ")
        return pc.split_pattern(pc.replace_with_mask(pieces, mixed, apart), " ")

    def _learn(self, words: pa.Array) -> np.ndarray:
        """Adds words that are not known; returns their places."""
        is_plain = self._is_plain(words).to_numpy(zero_copy_only=False)
        texts = words.to_numpy(zero_copy_only=False)  # ten times as fast as to_pylist()
        # No word is in both groups: what is not plain stays so.
        rest = self.tokenizer.encode_batch_fast(texts[~is_plain].tolist(), add_special_tokens=False)
        sizes, ids, number = [], [], attrgetter("id")
        for text in texts[is_plain].tolist():
            tokens = self.model.tokenize(text if text.isascii() else text.translate(self.spelling))
            sizes.append(len(tokens))
            ids.extend(map(number, tokens))
        for one in rest:
            sizes.append(len(one.ids))
            ids += one.ids
        order = np.concatenate((np.flatnonzero(is_plain), np.flatnonzero(~is_plain)))
        places = np.empty(len(order), np.int64)
        places[order] = np.arange(len(self.known), len(self.known) + len(order))
        self.known = pa.concat_arrays([self.known, words.take(pa.array(order))])
        self.sizes = np.concatenate((self.sizes, np.array(sizes, np.int64)))
        self.ids = np.concatenate((self.ids, np.array(ids, self.dtype)))
        self.met = np.concatenate((self.met, np.full(len(words), self.shares)))
        return places

    def _forget(self) -> None:
        """Keeps the cache within its limits."""
        keep = np.flatnonzero(pc.less_equal(pc.binary_length(self.known), LONGEST_CACHED).to_numpy(zero_copy_only=False))
        if len(keep) > MAX_CACHED:
            keep = np.sort(keep[np.argsort(-self.met[keep], kind="stable")[: MAX_CACHED // 2]])
        if len(keep) < len(self.known):
            self.ids, _ = self._gathered(self.sizes, self.ids, keep, np.zeros(1, np.int64))
            self.known, self.sizes, self.met = self.known.take(pa.array(keep)), self.sizes[keep], self.met[keep]

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of each text as bytes; a null text is an empty one."""
        out: list[bytes] = []
        share: list[str] = []
        size = 0
        for text in texts:
            share.append(text or "")
            size += len(share[-1])
            if size > SHARE:
                out += self._encode(share)
                share, size = [], 0
        return out + self._encode(share)

    def _encode(self, texts: list[str]) -> list[bytes]:
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        pieces = split.flatten().dictionary_encode()
        words = self._words(pieces.dictionary)
        distinct = words.flatten().dictionary_encode()
        self.shares += 1
        found = pc.index_in(distinct.dictionary, value_set=self.known)
        at = found.fill_null(-1).to_numpy().astype(np.int64)
        if found.null_count:
            at[at < 0] = self._learn(distinct.dictionary.filter(found.is_null()))
        self.met[at] = self.shares
        ids, bounds = self._gathered(self.sizes, self.ids, at[distinct.indices.to_numpy()], words.offsets.to_numpy())
        ids, bounds = self._gathered(np.diff(bounds), ids, pieces.indices.to_numpy(), split.offsets.to_numpy())
        self._forget()
        raw, ends = ids.tobytes(), (bounds * self.dtype.itemsize).tolist()
        return [raw[start:end] for start, end in zip(ends, ends[1:])]
