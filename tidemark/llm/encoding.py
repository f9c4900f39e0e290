"""Byte-pair encoding of whole batches with a public vocabulary file of the tokenizers library.

Both kinds of file cut a text into pieces that are encoded on their own. A word is therefore encoded once and
remembered, instead of at each place; Arrow finds the distinct words of a batch, numpy puts the ids together. Texts
that words alone do not decide, such as those with an added token's content, are encoded as a whole.
"""

from __future__ import annotations

import gc
import os
import re
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import forgetting

#: Words kept between batches; when there are more, those of one batch are forgotten. With more, a worker is faster and larger.
MEMORY = 200_000
#: Bytes of text to encode at once.
SLICE_BYTES = 3_000_000
#: New words that are encoded as one text.
RUN = 24
_OTHER = r"\t-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_SPACE = " " + _OTHER
#: White space that the byte-level rule keeps in one piece where this module would cut.
_RUN = f"[{_SPACE}][{_SPACE}](?:[{_SPACE}]|\\z)|\\x00"
#: Separators at which Arrow cuts words and drops them, while the tokenizer gives them ids.
_KEPT = r"[\x1c-\x1f]"
#: A letter and a sign after it, between which the byte-level rule always cuts; only those that are letters in any version of Unicode.
_SIGN = r"([A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{17f}])([!-/:-@\[-`{-~])"


class Encoder:
    """encode(texts) gives the ids of all texts in one array, and where each text's ids end."""

    def __init__(self, path: str, memory: int = MEMORY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memory = memory
        #: Added tokens, which the library looks for in the text as it is, before it cuts words.
        self.added = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        one = self.tokenizer.encode("a", add_special_tokens=False).ids
        #: Whether a space belongs to the word after it, as in byte-level files; else white space only parts words.
        self.spaced = self.tokenizer.encode(" a", add_special_tokens=False).ids != one
        # What can stand between words without changing their ids, and its id; words for which that fails go alone.
        self.between, inner = ("\n", "\n") if self.spaced else (" 0 ", "0")
        self.mark = self.tokenizer.encode(inner, add_special_tokens=False).ids[0]
        self.apart = f"(?s).[{_SPACE}]|^ ?$|^[{_OTHER}]" if self.spaced else "0|^$"
        if self.spaced:
            #: Bytes of each id: these files write each byte as one character.
            self.bytes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
            for token, i in self.tokenizer.get_vocab().items():
                self.bytes[i] = len(token)
        self.known: dict[str, int] = {}
        self.pool, self.begin, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        #: In how many batches each word came since words were last forgotten.
        self.uses = np.zeros(0, np.int32)

    def direct(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _thin(self) -> None:
        """Forgets words of one batch only and, of the others, those of the fewest batches if half the memory does not hold them."""
        kept = np.flatnonzero(self.uses > 1)
        if len(kept) > self.memory // 2:
            kept = np.sort(kept[np.argsort(-self.uses[kept], kind="stable")[: self.memory // 2]])
        place = np.full(len(self.size), -1, np.int64)
        place[kept] = np.arange(len(kept))
        self.known = {w: i for w, i in zip(self.known, place[np.fromiter(self.known.values(), np.int64, len(self.known))].tolist(), strict=True) if i >= 0}
        self.pool = _gather(self.pool, self.begin[kept], self.size[kept])
        self.size = self.size[kept]
        self.begin = np.cumsum(self.size) - self.size
        self.uses = np.ones(len(kept), np.int32)  # a word that does not come again goes the next time

    def _learn(self, words: pa.Array, names: list[str]) -> np.ndarray:
        """The numbers of new words, which are encoded RUN at a time in one text: fewer results to unpack than one for each word."""
        apart = np.asarray(pc.match_substring_regex(words, self.apart))
        odd = words.filter(pa.array(apart)).to_pylist()
        plain = words.filter(pa.array(~apart)) if odd else words
        gc.disable()  # many small lists, none in a cycle
        chunks, size = self._by_length(plain) if self.spaced else self._by_marks(plain.to_pylist())
        for w in odd:
            chunks.append(self.direct(w))
        gc.enable()
        size = np.concatenate((size, np.fromiter(map(len, chunks[len(chunks) - len(odd) :]), np.int64, len(odd))))
        number = np.zeros(len(words), np.int64)
        number[~apart] = len(self.size) + np.arange(len(plain))
        number[apart] = len(self.size) + len(plain) + np.arange(len(odd))
        self.known.update(zip(names, number.tolist(), strict=True))
        begin = len(self.pool) + np.cumsum(size) - size
        if self.spaced:  # line ends before words are no part of them
            first = np.zeros(len(size), bool)
            first[: len(plain)] = ~np.asarray(pc.starts_with(plain, " "))
            begin, size = begin + first, size - first
        self.begin = np.concatenate((self.begin, begin))
        self.size = np.concatenate((self.size, size))
        self.uses = np.concatenate((self.uses, np.zeros(len(size), np.int32)))
        self.pool = np.concatenate((self.pool, *chunks))
        return number

    def _ids(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all runs, and how many each has."""
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(runs, add_special_tokens=False)]
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.uint32, int(n.sum())), n

    def _by_length(self, words: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids of byte-level words and how many each has. A word begins with its space, any other with a line end before it.

        Each id stands for a fixed number of bytes, so the words' lengths say where in a run each begins.
        """
        spaced = pc.starts_with(words, " ")
        line, nothing = pa.scalar("\n", words.type), pa.scalar("", words.type)
        texts = pc.binary_join_element_wise(pc.if_else(spaced, nothing, line), words, nothing)
        ends = np.cumsum(np.asarray(pc.binary_length(texts), np.int64))
        starts = np.append(np.arange(0, len(texts), RUN), len(texts))
        runs = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(starts, pa.int64()), texts), nothing) if len(texts) else pa.array([], pa.large_string())
        chunks = [self._ids(runs[at : at + 256].to_pylist())[0] for at in range(0, len(runs), 256)]
        ids = np.concatenate((np.zeros(0, np.uint32), *chunks))
        bytes_to = np.cumsum(self.bytes[ids])
        stops = np.searchsorted(bytes_to, ends)
        begin = np.append(0, stops + 1)[: len(texts)]
        first = ~np.asarray(spaced)
        if len(texts) and (stops[-1] != len(ids) - 1 or (bytes_to[stops] != ends).any() or (ids[begin[first]] != self.mark).any()):
            raise ValueError("ids of two words in a run became one")
        return chunks, stops + 1 - begin

    def _by_marks(self, words: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids of words that white space parts, and how many each has, with a mark between words."""
        runs = [words[at : at + RUN] for at in range(0, len(words), RUN)]
        chunks, sizes = [], [np.zeros(0, np.int64)]
        for at in range(0, len(runs), 256):
            some = runs[at : at + 256]
            ids, n = self._ids([self.between.join(r) for r in some])
            marks = np.zeros(len(ids) + len(some), bool)
            last = np.cumsum(n + 1) - 1
            marks[last] = True
            inner = np.flatnonzero(~marks)
            marks[inner] = ids == self.mark
            stops = np.flatnonzero(marks)
            if len(stops) != sum(map(len, some)):
                raise ValueError("a mark between words did not stay one id")
            sizes.append(np.diff(stops, prepend=-1) - 1)
            chunks.append(ids[ids != self.mark])
        return chunks, np.concatenate(sizes)

    def _parts(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all these words in one array, and where each word begins and how many it has."""
        if self.spaced:  # a letter and a sign after it never are in one piece, so signs do not make new words
            cut = pc.split_pattern(pc.replace_substring_regex(words, _SIGN, "\\1\0\\2"), "\0")
            per_word, words = np.diff(np.asarray(cut.offsets)), cut.flatten()
        coded = words.dictionary_encode()
        names, at = coded.dictionary.to_pylist(), np.asarray(coded.indices)
        known = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        missing = np.flatnonzero(known < 0)
        if len(missing):
            known[missing] = self._learn(coded.dictionary.take(pa.array(missing)), [names[i] for i in missing.tolist()])
        self.uses[known] += 1
        n, begin = self.size[known][at], self.begin[known][at]
        if not self.spaced:
            return self.pool, begin, n
        stops = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(per_word)))]
        return _gather(self.pool, begin, n), stops[:-1], np.diff(stops)

    def encode(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids uint32, ends int64): text i has ids[ends[i - 1]:ends[i]]; null reads as empty."""
        texts = pc.fill_null(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()), "")
        whole = pc.match_substring_regex(texts, "|".join(filter(None, (_RUN if self.spaced else _KEPT, self.added))))
        odd = {i: self.direct(texts[i].as_py()) for i in np.flatnonzero(np.asarray(whole)).tolist()}
        texts = pc.if_else(whole, pa.scalar("", pa.large_string()), texts) if odd else texts
        if self.spaced:
            cut = pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n\0"), "\0")
        else:
            cut = pc.utf8_split_whitespace(texts)
        per_text = np.diff(np.asarray(cut.offsets))
        coded = cut.flatten().dictionary_encode()
        words, at = coded.dictionary, np.asarray(coded.indices)
        if len(self.known) > self.memory:
            self._thin()
        pool, begin, n = self._parts(words)
        n, begin = n[at], begin[at]
        ids = _gather(pool, begin, n)
        stops = np.concatenate(([0], np.cumsum(n)))
        counts = np.diff(stops[np.concatenate(([0], np.cumsum(per_text)))])
        if odd:
            chunks = np.split(ids, np.cumsum(counts)[:-1])
            for i, own in odd.items():
                chunks[i] = own
            counts = np.fromiter(map(len, chunks), np.int64, len(chunks))
            ids = np.concatenate(chunks)
        return ids, np.cumsum(counts)


def _gather(pool: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """pool[begin : begin + n] of all places, one after the other."""
    stops = np.cumsum(n)
    total = int(stops[-1]) if len(stops) else 0
    place = np.repeat((begin - (stops - n)).astype(np.int32), n)  # the pool is far below 2**31
    place += np.arange(total, dtype=np.int32)
    return pool[place]


@lru_cache(2)
def encoder(path: str, memory: int = MEMORY) -> Encoder:
    """The worker's encoder for a file: it and what it remembers serve all tasks of the worker that encode."""
    return Encoder(path, memory)


forgetting.append(encoder.cache_clear)
