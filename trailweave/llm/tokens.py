"""Exact token ids at the speed of an array look-up.

The tokenizer library spends most of its time on words that it has seen before. The bytes of
many texts are cut, all at once, before white space that follows a visible character, and
between letters and punctuation. No token and no look-ahead of either vocabulary straddles
such a cut, so the ids of a text are those of its chunks. Equal chunks of a batch are found by Arrow; their ids lie in one bounded
table, and only chunks that are new to it go through the library, many to a call.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from trailweave.llm.common import utf8

LONGEST = 64  # bytes of a chunk that the table keeps; longer ones go through the library each time
TOGETHER = 128  # new chunks to a call

#: A blank or line break, or none, and a word without white space or control characters.
WORD = re.compile(
    rb"[ \n]?(?:[\x21-\x7e]|[\xc3-\xdf].|\xe0..|\xe1[^\x9a\xa0].|\xe2(?:\x80[\x90-\xa7\xb0-\xbf]|[^\x80\x81].)|\xe3[^\x80].|[\xe4-\xef]..|[\xf0-\xf4]...)+", re.DOTALL
)

_plain = np.zeros(256, bool)
_plain[0x21:0x7F] = True
_letter = np.zeros(256, bool)
_letter[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_mark = _plain & ~_letter
_mark[0x30:0x3A] = False
_closed = _mark.copy()
_closed[0x27] = False  # an apostrophe may belong to the letters behind it


def chunk_starts(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where chunks start, and the end of the last. Cuts are before a blank or line break
    that follows a visible ASCII character or the end of a longer one that isn't space, before
    ASCII punctuation that follows a letter, and behind it where an ASCII letter comes."""
    cut = np.zeros(len(data) + 1, bool)
    cut[edges] = True
    cut[-1] = True
    if len(data) > 1:
        space = (data == 0x20) | (data == 0x0A)
        cut[1:-1] |= space[1:] & _plain[data[:-1]]
        mark, letter = _mark[data], _letter[data]
        cut[1:-1] |= mark[1:] & letter[:-1] | letter[1:] & _closed[data[:-1]]
        latin = np.flatnonzero(mark[1:] & (data[:-1] >= 0x80))
        cut[latin[(data[latin - 1] == 0xC3) & (data[latin] != 0x97) & (data[latin] != 0xB7)] + 1] = True
        high = np.flatnonzero(space[1:] & (data[:-1] >= 0x80))
        two, three = data[high - 1], data[high - 2]
        blank = (two == 0xC2) | ((three == 0xE1) & ((two == 0x9A) | (two == 0xA0))) | ((three == 0xE2) & (two <= 0x81)) | ((three == 0xE3) & (two == 0x80))
        cut[high[~blank] + 1] = True
    return np.flatnonzero(cut)


def folded(data: np.ndarray, tokens: bool) -> np.ndarray:
    """For a vocabulary without case and white space: line breaks as blanks, and ASCII letters
    in lower case but where something behind may change them, or (``tokens``) where the
    string of an added token might come about."""
    out = np.where(data == 0x0A, np.uint8(0x20), data)
    if not tokens:
        upper = (data >= 0x41) & (data <= 0x5A)
        upper[:-1] &= data[1:] < 0x80
        out[upper] += 0x20
    return out


class Encoder:
    """Ids of whole texts, as the library's plain call gives them: strings of added tokens in
    a text become those tokens.

    kind: "word" for a vocabulary that drops white space and case, "byte" for byte-level BPE
    that glues a blank to the word behind it. ``chunks`` bounds the table.
    """

    def __init__(self, path: str, kind: str, chunks: int = 700_000):
        from tokenizers import Tokenizer

        self.library, self.kind, self.limit = Tokenizer.from_file(path), kind, chunks
        if hasattr(self.library.model, "_resize_cache"):  # the table does its work
            self.library.model._resize_cache(0)
        self.added = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.glue = b" \x00 " if kind == "word" else b"\n"
        got = self._direct("\x00" if kind == "word" else "\n")
        self.mark_id = got[0] if len(got) == 1 else None
        self._clear()

    def _clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat, self.used, self.n = np.zeros(1 << 16, np.uint32), 0, 0
        self.place, self.size, self.hits = (np.zeros(1 << 15, np.int64) for _ in range(3))

    def _direct(self, text: str) -> list[int]:
        return self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _joined(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids one after another and the number of each: chunks are joined by a mark, encoded
        in one call and cut at the mark's id."""
        found, sizes = [], []
        for start in range(0, len(keys), TOGETHER):
            some = keys[start : start + TOGETHER]
            ids = np.array(self._direct(self.glue.join(some).decode()), np.uint32)
            cuts = np.flatnonzero(ids == self.mark_id)
            if len(cuts) == len(some) - 1:
                found.append(np.delete(ids, cuts))
                sizes.append(np.diff(cuts, prepend=-1, append=len(ids)) - 1)
            else:
                found.append(self._each(some, sizes))
        return np.concatenate(found), np.concatenate(sizes)

    def _each(self, keys: list[bytes], sizes: list[np.ndarray]) -> np.ndarray:
        got = [self._direct(k.decode("utf-8", "surrogatepass")) for k in keys]
        sizes.append(np.array([len(x) for x in got], np.int64))
        return np.array([i for x in got for i in x], np.uint32)

    def _learn(self, keys: list[bytes]) -> np.ndarray:
        """Numbers in the table for chunks that it doesn't have."""
        plain, broken, rest = [], [], []
        for i, key in enumerate(keys):
            if self.mark_id is None or len(key) > LONGEST or not WORD.fullmatch(key):
                rest.append(i)
            elif self.kind == "byte" and key[0] == 0x0A:
                broken.append(i)
            else:
                plain.append(i)
        numbers = np.zeros(len(keys), np.int64)
        for own, kind in ((plain, 0), (broken, 1), (rest, 2)):
            if not own:
                continue
            if kind == 0:
                ids, sizes = self._joined([keys[i] for i in own])
            elif kind == 1:  # the line break is a token of its own
                ids, sizes = self._joined([keys[i][1:] for i in own])
                ids, sizes = np.insert(ids, np.cumsum(sizes) - sizes, self.mark_id), sizes + 1
            else:
                held: list[np.ndarray] = []
                ids = self._each([keys[i] for i in own], held)
                sizes = held[0]
            numbers[own] = self._add(ids, sizes)
        self.index.update((k, n) for k, n in zip(keys, numbers.tolist()) if len(k) <= LONGEST)
        return numbers

    def _add(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        first, self.n = self.n, self.n + len(sizes)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while self.n > len(self.size):
            self.place, self.size, self.hits = (np.concatenate((x, np.zeros_like(x))) for x in (self.place, self.size, self.hits))
        self.flat[self.used : self.used + len(ids)] = ids
        self.place[first : self.n] = self.used + np.cumsum(sizes) - sizes
        self.size[first : self.n] = sizes
        self.used += len(ids)
        return np.arange(first, self.n)

    def _sweep(self) -> None:
        """Keep the chunks met in most batches, half a table at most."""
        keys, hits = list(self.index), self.hits[list(self.index.values())]
        enough = max(2, int(np.partition(hits, -(self.limit // 2))[-(self.limit // 2)]) + 1 if len(hits) > self.limit // 2 else 2)
        old = [(k, self.index[k]) for k, h in zip(keys, hits.tolist()) if h >= enough]
        numbers = np.array([v for _, v in old], np.int64)
        place, sizes, seen = self.place[numbers], self.size[numbers], self.hits[numbers]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(place - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        self._clear()
        self.index = {k: i for i, (k, _) in enumerate(old)}
        self._add(ids, sizes)
        self.hits[: self.n] = seen // 2

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, edges = utf8(texts)
        raw = data.tobytes()
        if any(a in raw for a in self.added):
            return self._with_added(texts, {i for i in range(len(texts)) if any(a in raw[edges[i] : edges[i + 1]] for a in self.added)})
        if not raw:
            return np.zeros(0, np.uint32), np.zeros(len(edges), np.int64)
        if self.kind == "word":
            data = folded(data, b"<|" in raw)
            raw = data.tobytes()
        starts = chunk_starts(data, edges)
        chunks = pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(raw)]).dictionary_encode()
        keys = chunks.dictionary.to_pylist()
        got = list(map(self.index.get, keys))
        new = [i for i, v in enumerate(got) if v is None]
        if new and self.n and self.n + len(new) > self.limit:
            self._sweep()
            got = list(map(self.index.get, keys))
            new = [i for i, v in enumerate(got) if v is None]
        if new:
            for i, number in zip(new, self._learn([keys[i] for i in new]).tolist()):
                got[i] = number
        numbers = np.array(got, np.int64)
        self.hits[numbers] += 1
        numbers = numbers[chunks.indices.to_numpy(zero_copy_only=False)]
        sizes = self.size[numbers]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.place[numbers] - ends + sizes, sizes) + np.arange(ends[-1])]
        return ids, np.concatenate(([0], ends))[np.searchsorted(starts, edges)]

    def _with_added(self, texts: pa.Array, odd: set[int]) -> tuple[np.ndarray, np.ndarray]:
        """Texts that hold an added token's string go through the library whole."""
        each = []
        for i in range(len(texts)):
            each.append(np.array(self._direct(texts[i].as_py()), np.uint32) if i in odd else self._slice(texts.slice(i, 1))[0])
        return np.concatenate(each), np.concatenate(([0], np.cumsum([len(x) for x in each])))

    def slices(self, texts: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For slices of about ``most`` bytes: the first row, the ids of all its texts one after
        another, and where each text's ids start, with the end of the last. Null is empty."""
        _, edges = utf8(texts)
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(edges, edges[first] + most)))
            ids, bounds = self._slice(texts.slice(first, last - first))
            yield first, ids, bounds
            first = last

    def documents(self, texts: pa.Array, end_id: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """The same with ``end_id`` behind the ids of each text."""
        for first, ids, bounds in self.slices(texts):
            yield first, np.insert(ids, bounds[1:], end_id).astype("<u4", copy=False), bounds + np.arange(len(bounds))

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out = []
        for _, ids, bounds in self.slices(pa.array(texts, pa.string())):
            out += [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        return out


@lru_cache(maxsize=2)
def encoder(path: str, kind: str, chunks: int = 700_000) -> Encoder:
    """One for each worker process, kept from task to task."""
    return Encoder(path, kind, chunks)
