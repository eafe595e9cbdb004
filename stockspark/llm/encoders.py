"""Token ids from a public vocabulary, remembered per piece of text.

Texts are handled many at a time, as one array of bytes.  It is cut where the byte-level
pre-tokenizer begins a new pre-token whatever else the text holds: between letters, digits and
other characters, before white space, after a line end or tab, and before the last of several
white spaces.  The pieces encode independently; each different piece of a chunk is looked up once
and encoded by the tokenizers library if it is not known.  Texts with characters outside the plain
range or with special strings go through the library whole, and so does every text of a vocabulary
with another pre-tokenizer.
"""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np
import pyarrow as pa

from stockspark.llm.common import remembered, word_hash

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words that one worker remembers (token counts); beyond them it keeps the first quarter, as common words come early.
REMEMBERED = 800_000
#: The same for the encoder's pieces (about 50 bytes each), none of them longer than LONGEST bytes.
KNOWN_PIECES, LONGEST = 1_000_000, 64

#: Kinds of characters; only texts without BAD ones are cut.
SPACE, LETTER, DIGIT, OTHER, BAD = range(5)
_MAJOR = {"L": LETTER, "N": DIGIT}
_KIND = np.full(0x2100, BAD, dtype=np.uint8)
for _c in (*range(0x21, 0x7F), *range(0xA1, 0x250), *range(0x2010, 0x2028)):
    _KIND[_c] = _MAJOR.get(unicodedata.category(chr(_c))[0], OTHER)
_KIND[[0x20, *range(0x09, 0x0E)]] = SPACE
_ASCII = np.concatenate((_KIND[:0x80], np.full(0x80, BAD, dtype=np.uint8)))


def load(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def specials(tokenizer) -> list[str]:
    return [t.content for t in tokenizer.get_added_tokens_decoder().values()]


#: Characters of unknown pieces that the library encodes in one call.
BATCH_CHARS = 128 << 10


def _kinds(data: np.ndarray) -> np.ndarray:
    """The kind of the character that each byte of UTF-8 belongs to (BAD outside the plain range)."""
    kind = _ASCII[data]
    high = np.flatnonzero(data >= 0x80)
    lead = high[data[high] >= 0xC0]
    byte = np.concatenate((data, np.zeros(2, dtype=np.uint8))).astype(np.int32) if len(lead) else None
    for n, first, last in ((2, 0xC2, 0xC9), (3, 0xE2, 0xE2)):
        at = lead[(data[lead] >= first) & (data[lead] <= last) & (lead + n <= len(data))]
        if not len(at):
            continue
        code = byte[at] & (0x1F if n == 2 else 0x0F)
        for k in range(1, n):
            code = (code << 6) | (byte[at + k] & 0x3F)
        found = np.where(code < len(_KIND), _KIND[np.minimum(code, len(_KIND) - 1)], BAD)
        for k in range(n):
            kind[at + k] = found
    return kind


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] of them), start[1], ..."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 1 << 30 and (not len(start) or int(start.max()) < 1 << 30) else np.int64
    return np.repeat((start - (ends - size)).astype(kind), size) + np.arange(total, dtype=kind)


class _Growing:
    """Runs of numbers kept one after another."""

    def __init__(self, kind):
        self.values, self.ends = np.zeros(0, dtype=kind), np.zeros(1, dtype=np.int64)

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs at these places, one after another, and their sizes."""
        start, size = self.ends[at], self.ends[at + 1] - self.ends[at]
        return self.values[_runs(start, size)], size

    def add(self, values: np.ndarray, size: np.ndarray) -> None:
        self.values = np.concatenate((self.values, values.astype(self.values.dtype)))
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(size)))

    def keep(self, n: int) -> None:
        self.ends = self.ends[: n + 1].copy()
        self.values = self.values[: self.ends[-1]].copy()


class _Known:
    """Pieces and their ids in flat arrays, found by hash and compared by their bytes."""

    def __init__(self, kind):
        self.hash, self.place = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)
        self.text, self.ids = _Growing(np.uint8), _Growing(kind)

    def find(self, key: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The place of each piece data[start:start + size], -1 where it is not known."""
        out = np.full(len(key), -1, dtype=np.int64)
        if not len(self.hash):
            return out
        order = np.argsort(key)
        at = np.minimum(np.searchsorted(self.hash, key[order]), len(self.hash) - 1)
        hit = self.hash[at] == key[order]
        out[order[hit]] = self.place[at[hit]]
        some = np.flatnonzero(out >= 0)
        same = self.text.ends[out[some] + 1] - self.text.ends[out[some]] == size[some]
        out[some[~same]] = -1
        some = some[same]
        mine, sizes = self.text.take(out[some])
        if len(mine):
            differs = mine != data[_runs(start[some], sizes)]
            out[some[np.repeat(np.arange(len(some)), sizes)[differs]]] = -1
        return out

    def add(self, key: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray, ids: np.ndarray, first: np.ndarray, n_ids: np.ndarray) -> None:
        """Remember pieces with their ids; of pieces with one hash only the first."""
        key, at = np.unique(key, return_index=True)
        where = np.searchsorted(self.hash, key)
        free = np.ones(len(key), dtype=bool)
        if len(self.hash):
            free = self.hash[np.minimum(where, len(self.hash) - 1)] != key
        key, at, where = key[free], at[free], where[free]
        place = (len(self.text.ends) - 1 + np.arange(len(key))).astype(np.int32)
        self.text.add(data[_runs(start[at], size[at])], size[at])
        self.ids.add(ids[_runs(first[at], n_ids[at])], n_ids[at])
        self.hash, self.place = np.insert(self.hash, where, key), np.insert(self.place, where, place)

    def keep(self, n: int) -> None:
        stays = self.place < n
        self.hash, self.place = self.hash[stays], self.place[stays]
        self.text.keep(n)
        self.ids.keep(n)


class Encoder:
    """Ids as the library gives them, without added special tokens.

    Unknown pieces of many texts are put together, encoded in one call and cut apart again by the
    bytes that every token stands for.
    """

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.special = [s.encode() for s in specials(self.tokenizer)]
        vocabulary = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, number in vocabulary.items():
            self.width[number] = len(token)  # one character of a token is one byte
        self.known = _Known(np.uint16 if len(self.width) <= 1 << 16 else np.int32)
        first = self.tokenizer.pre_tokenizer
        form = json.loads(first.__getstate__()) if first is not None else {}
        self.cuts = self.tokenizer.normalizer is None and form.get("type") == "ByteLevel" and form.get("use_regex") is True and form.get("add_prefix_space") is False

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.int32)

    def _cut(self, joined: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces begin, and the numbers of those that are whole texts, not plain ones."""
        data = np.frombuffer(joined, dtype=np.uint8)
        cut = np.zeros(len(data), dtype=bool)
        some = np.flatnonzero(end > start)
        odd = some
        if self.cuts:
            kind = _kinds(data)
            # a plain space belongs to what follows it, and so may an apostrophe
            cut[1:] = (kind[1:] != kind[:-1]) & (data[:-1] != 0x20) & ~((data[:-1] == 0x27) & (kind[1:] == LETTER))
            # the last of several white spaces, if the text goes on after it
            space = kind == SPACE
            several = np.flatnonzero(space[1:-1] & space[:-2] & ~space[2:]) + 1
            cut[np.setdiff1d(several, end - 1)] = True
            wrong = [np.flatnonzero(kind == BAD)]
            for special in self.special:
                at = joined.find(special)
                while at >= 0:
                    wrong.append(np.array([at, at + len(special) - 1]))
                    at = joined.find(special, at + 1)
            odd = np.unique(np.searchsorted(end, np.concatenate(wrong), side="right"))
            for i in odd.tolist():
                cut[start[i] : end[i]] = False
        cut[start[some]] = True
        begin = np.flatnonzero(cut)
        return begin, np.searchsorted(begin, start[odd])

    def _together(self, data: np.ndarray, size: np.ndarray, line_ends: bool) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces that lie one after another, and how many each has; between pieces that begin with no space comes a line end."""
        ids, n_ids, at = [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.int64)], 0
        bounds = np.concatenate(([0], np.cumsum(size)))
        while at < len(size):
            stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + BATCH_CHARS, side="right")) - 1)
            joined, ends = data[bounds[at] : bounds[stop]], bounds[at + 1 : stop + 1] - bounds[at]
            if line_ends:
                joined, ends = np.insert(joined, bounds[at:stop] - bounds[at], ord("\n")), ends + np.arange(1, stop - at + 1)
            got = np.asarray(self.tokenizer.encode_batch_fast([joined.tobytes().decode()], add_special_tokens=False)[0].ids, dtype=np.int32)
            reached = np.cumsum(self.width[got])
            last = np.searchsorted(reached, ends)
            first = np.concatenate(([0], last[:-1] + 1))
            exact = len(reached) and last[-1] < len(reached) and (reached[last] == ends).all()
            if exact and (not line_ends or (self.width[got[first]] == 1).all()):
                n_ids.append(last - first + (0 if line_ends else 1))
                ids.append(np.delete(got, first) if line_ends else got)
            else:  # a token reaches over a piece's end: not with the pre-tokenizer whose texts are cut
                alone = [self.whole(data[s:e].tobytes().decode()) for s, e in zip(bounds[at:stop].tolist(), bounds[at + 1 : stop + 1].tolist())]
                n_ids.append(np.fromiter(map(len, alone), dtype=np.int64, count=len(alone)))
                ids.extend(alone)
            at = stop
        return np.concatenate(ids), np.concatenate(n_ids)

    def _learn(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The order in which the pieces are encoded, their ids one after another, and how many each has."""
        alone = odd | (_ASCII[data[start + size - 1]] == SPACE)  # what ends with white space is nothing else
        spaced = ~alone & (data[start] == 0x20)
        order, ids, n_ids = [], [], []
        for some, line_ends in ((np.flatnonzero(spaced), False), (np.flatnonzero(~spaced & ~alone), True)):
            got, sizes = self._together(data[_runs(start[some], size[some])], size[some], line_ends)
            order.append(some)
            ids.append(got)
            n_ids.append(sizes)
        some = np.flatnonzero(alone)
        got = [self.whole(data[s:e].tobytes().decode()) for s, e in zip(start[some].tolist(), (start[some] + size[some]).tolist())]
        sizes = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
        return np.concatenate((*order, some)), np.concatenate((*ids, *got)), np.concatenate((*n_ids, sizes))

    def flat(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each text has."""
        joined, sizes = b"".join(texts), np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        if not joined:
            return np.zeros(0, dtype=np.int32), sizes
        end = np.cumsum(sizes)
        begin, odd_pieces = self._cut(joined, end - sizes, end)
        offsets = np.append(begin, len(joined))
        coded = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(joined)]).dictionary_encode()
        code, words = coded.indices.to_numpy(), coded.dictionary
        data, bounds = np.frombuffer(words.buffers()[2], dtype=np.uint8), np.frombuffer(words.buffers()[1], dtype=np.int64)[: len(words) + 1]
        start, size = bounds[:-1], np.diff(bounds)
        odd = np.zeros(len(words), dtype=bool)
        odd[code[odd_pieces]] = True

        if len(self.known.hash) > KNOWN_PIECES:
            self.known.keep(KNOWN_PIECES // 4)
        short = np.flatnonzero((size <= LONGEST) & ~odd)
        key = word_hash(data.tobytes(), start[short], bounds[1:][short])
        place = self.known.find(key, data, start[short], size[short])
        found = place >= 0
        old_ids, n_old = self.known.ids.take(place[found])
        new = np.setdiff1d(np.arange(len(words)), short[found])
        order, new_ids, n_new = self._learn(data, start[new], size[new], odd[new])

        # all ids of the chunk's words: those known, then those just learned
        ids, counts = np.concatenate((old_ids.astype(np.int32), new_ids)), np.concatenate((n_old, n_new))
        word = np.concatenate((short[found], new[order]))
        n_ids, first = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        n_ids[word], first[word] = counts, np.cumsum(counts) - counts
        learned = short[~found]
        self.known.add(key[~found], data, start[learned], size[learned], ids, first[learned], n_ids[learned])

        n_pieces = n_ids[code]
        until = np.concatenate(([0], np.cumsum(n_pieces)))[np.searchsorted(begin, end)]
        return ids[_runs(first[code], n_pieces)], np.diff(until, prepend=0)

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of every text."""
        ids, n_ids = self.flat([t.encode() for t in texts])
        return np.split(ids, np.cumsum(n_ids)[:-1]) if texts else []

    def ids(self, text: str) -> np.ndarray:
        return self.batch([text])[0]


def encoder(path: str) -> Encoder:
    """The worker's encoder: what it remembers serves all tasks of the worker."""
    memory = remembered("encoder")
    if path not in memory:
        memory[path] = Encoder(path)
    return memory[path]
