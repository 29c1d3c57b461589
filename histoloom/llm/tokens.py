"""Batch tokenising for Spark tasks: the tokenizers library sees each distinct word of a batch once.

Both vocabularies cut a text before every space or line feed that follows a visible character, and before every sentence
mark that follows a letter, whatever surrounds them, so the ids of a text are those of its words and marks, joined. Where a
vocabulary has neither capitals nor white space, words are looked up in lower case. New words go to the library many at a
time, as one text. A text with any other white space, with runs of it, or with a special token's spelling goes there whole.
"""

from __future__ import annotations

import functools
import itertools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from histoloom.llm.workers import keep_for

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism

#: Text bytes that are tokenised at once; bounds a task's memory.
BATCH_BYTES = 4 << 20
#: Distinct words whose ids a worker keeps, and the share of the first ones (the frequent ones) that outlasts the others.
CACHED_WORDS, LASTING_SHARE = 300_000, 0.4
#: Words that the library gets as one text.
TOGETHER = 500
#: What parts words, and what opens a mark that stood right behind a letter; no text that is cut into words holds the latter.
_SPECIAL, _CLOSE = "<|endoftext|>", "\x1f"
#: White space other than single spaces and line feeds between words, and a letter that in lower case ends in none.
_OTHER_SPACE = r"[\t\r\x0b\x0c\x00\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}\x{130}]"


class Encoder:
    """Ids of many texts as one flat array plus a length for each text."""

    def __init__(self, path: str, kept_words: int = CACHED_WORDS):
        self._kept_words = kept_words
        self._tokenizer = Tokenizer.from_file(path)
        upper, lower = self._whole([" A", "a"])
        self._folds = upper.tolist() == lower.tolist()
        self._parting = self._tokenizer.token_to_id(_SPECIAL)
        self._spaced = np.zeros(self._tokenizer.get_vocab_size(), bool)  # ids that begin with a space
        if not self._folds:
            space = self._tokenizer.id_to_token(int(self._whole([" a"])[0][0]))[0]
            self._spaced[[k for token, k in self._tokenizer.get_vocab().items() if token.startswith(space)]] = True
        self._index: dict[str, int] = {}
        self._ids = np.zeros(0, np.uint32)
        self._starts = np.zeros(0, np.int64)
        self._lengths = np.zeros(0, np.int64)

    def _forget(self, lasting: int) -> None:
        """Keep the first `lasting` words only."""
        self._index = dict(itertools.islice(self._index.items(), lasting))
        self._starts, self._lengths = self._starts[:lasting].copy(), self._lengths[:lasting].copy()
        self._ids = self._ids[: int(self._lengths.sum())].copy()

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(x.ids, np.uint32) for x in found]

    def _together(self, words: list[str], parting: str) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids of each word). parting: stands between words; empty where each begins with a space, and its ids show that."""
        flat = np.concatenate(self._whole([parting.join(["", *words[k : k + TOGETHER]]) for k in range(0, len(words), TOGETHER)]))
        at = np.nonzero(flat == self._parting if parting else self._spaced[flat])[0]
        lengths = np.diff(at, append=len(flat))
        return (flat[flat != self._parting], lengths - 1) if parting else (flat, lengths)

    def _words(self, words: list[str]) -> np.ndarray:
        """Positions of the words in the kept table; unknown ones are tokenised first."""
        if len(self._index) + len(words) > self._kept_words:
            self._forget(int(LASTING_SHARE * self._kept_words))
        new = dict.fromkeys(w for w in words if w not in self._index)
        spaced = [] if self._folds else [w for w in new if w[:1] == " " and len(w) > 1]
        parted = list(new) if self._folds else [w for w in new if w[:1] != " " or len(w) == 1]
        for some, parting in ((spaced, ""), (parted, _SPECIAL)):
            if some:
                ids, lengths = self._together(some, parting)
                base, first = len(self._ids), len(self._index)
                self._starts = np.concatenate([self._starts, base + np.cumsum(lengths) - lengths])
                self._lengths = np.concatenate([self._lengths, lengths])
                self._ids = np.concatenate([self._ids, ids])
                self._index.update(zip(some, range(first, first + len(some))))
        return np.fromiter(map(self._index.__getitem__, words), np.int64, len(words))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids of each text). texts: strings without nulls."""
        texts = texts.cast(pa.large_string())
        odd = pc.or_(pc.match_substring_regex(texts, _OTHER_SPACE), pc.match_substring_regex(texts, "[ \n][ \n]|^[ \n]"))
        odd = pc.or_(odd, pc.match_substring(texts, "<|"))
        odd = odd.to_numpy(zero_copy_only=False)
        counts = np.zeros(len(texts), np.int64)
        plain = texts.filter(pa.array(~odd))
        if not len(plain):
            flat = np.zeros(0, np.uint32)
        else:
            mark = " " if self._folds else " " + _CLOSE
            plain = pc.replace_substring_regex(plain, r"(\pL)([.,;:!?])", rf"\1{mark}\2")
            if self._folds:
                parts = pc.split_pattern(pc.ascii_lower(pc.replace_substring(plain, "\n", " ")), " ")
            else:
                # A line feed starts a word just as a space does; its word keeps it, the others get their space back below.
                parts = pc.split_pattern(pc.replace_substring(plain, "\n", " \n"), " ")
            offsets = np.asarray(parts.offsets)
            coded = parts.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
            words = coded.dictionary.to_pylist()
            if self._folds:
                codes = self._words(words)[np.asarray(coded.indices)]
            else:
                firsts = offsets[:-1] - offsets[0]
                opening = coded.indices.take(pa.array(firsts))
                opening_words = pc.unique(opening)
                at = self._words([w if w[:1] == "\n" else w[1:] if w[:1] == _CLOSE else " " + w for w in words] + [words[k] for k in opening_words.to_pylist()])
                codes = at[np.asarray(coded.indices)]
                codes[firsts] = at[len(words) + np.asarray(pc.index_in(opening, opening_words))]
            lengths = self._lengths[codes]
            ends = np.cumsum(lengths)
            at = np.repeat((self._starts[codes] - ends + lengths).astype(np.int32), lengths)  # batches and kept ids are far below 2^31
            at += np.arange(len(at), dtype=np.int32)
            flat = self._ids[at]
            total = np.concatenate([[0], ends])
            counts[~odd] = np.diff(total[offsets - offsets[0]])
        if odd.any():
            whole = iter(self._whole(texts.filter(pa.array(odd)).to_pylist()))
            cuts = np.concatenate([[0], np.cumsum(counts)])
            pieces = [next(whole) if o else flat[cuts[k] : cuts[k + 1]] for k, o in enumerate(odd)]
            counts = np.fromiter(map(len, pieces), np.int64, len(pieces))
            flat = np.concatenate(pieces)
        return flat, counts


@functools.lru_cache(maxsize=4)
def encoder(path: str, kept_words: int = CACHED_WORDS) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    return Encoder(path, kept_words)


def _forget_encoders() -> bool:
    there = encoder.cache_info().currsize > 0
    encoder.cache_clear()
    return there


keep_for({"histoloom.llm.packing", "histoloom.llm.token_files"}, _forget_encoders)


def encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int, text: str = "text", frugal: bool = False) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches of a bounded size with their flat ids and lengths, the end id after each text. Null text: empty. frugal: half the memory for some more time."""
    table, batch_bytes = (encoder(path, CACHED_WORDS // 3), BATCH_BYTES // 2) if frugal else (encoder(path), BATCH_BYTES)
    for batch in batches:
        texts = batch.column(text).fill_null("")
        ends = np.cumsum(np.asarray(pc.binary_length(texts)))
        cuts = np.searchsorted(ends, np.arange(batch_bytes, (ends[-1] if len(ends) else 0) + batch_bytes, batch_bytes), side="left") + 1
        start = 0
        for cut in [*np.minimum(cuts, len(texts)).tolist(), len(texts)]:
            if cut <= start:
                continue
            flat, counts = table.encode(texts.slice(start, cut - start))
            ends_of = np.cumsum(counts + 1)
            out = np.full(ends_of[-1], end_id, np.uint32)
            keep = np.ones(len(out), bool)
            keep[ends_of - 1] = False
            out[keep] = flat
            yield batch.slice(start, cut - start), out, counts + 1
            start = cut


def binary_column(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column over consecutive stretches of a flat array; ends in bytes."""
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())
