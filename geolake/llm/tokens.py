"""Token ids of whole texts by public tokenizers, fast enough for a corpus.

Both tokenizers cut a text, before any merge, at places that the characters next to them decide. Texts are split at some of
those places, so the ids of a text are the ids of its pieces joined, and a piece that a worker met before costs a look-up by
its 64-bit hash. All pieces are encoded by the tokenizers library. Finding pieces, looking them up and joining
their ids is done for a block of texts at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa

from .common import blocks, hashes, text_buffer

#: Pieces that a worker keeps at most; then it starts anew. Results don't depend on it.
KEPT = 1_000_000
BLOCK = 1 << 20
#: Pieces in a text while pieces are encoded.
JOINED = 256

# Kinds of bytes. Two-byte letters from À to ÿ count as letters; texts with other bytes are encoded whole.
_BLANK, _LINE, _LETTER, _MARK, _OTHER, _BAD = range(6)
_KIND = np.full(256, _BAD, np.uint8)
_KIND[33:127] = _MARK
_KIND[[*range(65, 91), *range(97, 123), *range(128, 192), 0xC3]] = _LETTER
_KIND[[39, *range(48, 58)]] = _OTHER  # apostrophe and digits: a run up to the next white space stays one piece
_KIND[32], _KIND[10] = _BLANK, _LINE


class Encoder:
    """keeps_space: ids cover white space too (a blank belongs to what follows it); otherwise white space is dropped."""

    def __init__(self, path: str, keeps_space: bool):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.keeps_space = keeps_space
        self.blank = np.zeros(self.tokenizer.get_vocab_size(), bool)  # ids that begin with a blank
        self.blank[[i for t, i in self.tokenizer.get_vocab().items() if t[0] == "\u0120"]] = True
        self._reset()

    def _reset(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # ascending hashes and their pieces' numbers
        self.ids, self.used = np.zeros(1 << 20, np.uint32), 0
        self.start, self.n = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of every piece, and all ids. Pieces that begin with their only blank are joined, many to a text: it is cut before every
        blank, and only a piece's first id begins with one. They stand before the others in `texts`."""
        joined = sum(t[0] == " " for t in texts) if self.keeps_space else 0
        found = self.whole(["".join(texts[i : min(joined, i + JOINED)]) for i in range(0, joined, JOINED)])
        flat = np.fromiter(chain.from_iterable(found), np.uint32)
        first = np.flatnonzero(self.blank[flat])
        if len(first) != joined:  # a piece has another blank
            joined, flat, first = 0, flat[:0], first[:0]
        found = self.whole(texts[joined:])
        n = np.concatenate([np.diff(np.append(first, len(flat))), np.fromiter(map(len, found), np.int64, len(found))])
        return n, np.concatenate([flat, np.fromiter(chain.from_iterable(found), np.uint32)])

    def _learn(self, keys: np.ndarray, texts: list[str]) -> np.ndarray:
        """Encode pieces that weren't known; their numbers."""
        order = None
        if self.keeps_space:
            # pieces behind a blank first, so that they can be joined
            order = sorted(range(len(texts)), key=lambda i: texts[i][0] != " ")
            keys, texts = keys[order], [texts[i] for i in order]
        n, flat = self._encoded(texts)
        k = np.arange(len(self.keys), len(self.keys) + len(n))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while k[-1] >= len(self.n):
            self.start, self.n = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.n))
        self.ids[self.used : self.used + len(flat)] = flat
        self.n[k] = n
        self.start[k] = self.used + np.cumsum(n) - n
        self.used += len(flat)
        up = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[up])
        self.keys, self.slots = np.insert(self.keys, at, keys[up]), np.insert(self.slots, at, k[up])
        if order is None:
            return k
        out = np.empty_like(k)
        out[order] = k
        return out

    def _pieces(self, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and end bytes of all pieces, and a mark for each row that must be encoded whole."""
        n = len(buf)
        kind = _KIND[buf]
        before = np.concatenate([[_LINE], kind[:-1]]).astype(np.uint8)
        edge = at[:-1][np.diff(at) > 0]
        lead = buf == 0xC3
        odd = kind == _BAD
        high = (buf >= 128) & ~lead
        odd |= high & np.concatenate([[True], ~lead[:-1]])
        odd |= high & ((buf == 0x97) | (buf == 0xB7))  # the signs × and ÷
        space = kind <= _LINE
        if self.keeps_space:
            pair = space & (before <= _LINE)
            pair[edge] = space[edge]
            odd |= pair
            last = at[1:][np.diff(at) > 0] - 1
            odd[last] |= space[last]
        bad = np.flatnonzero(odd)
        slow = np.zeros(len(at) - 1, bool)
        slow[np.searchsorted(at, bad, "right") - 1] = True
        before[edge] = _LINE
        chunk = ~space & (before <= _LINE)
        starts = np.flatnonzero(chunk)
        turns = np.flatnonzero(((kind == _LETTER) & (before == _MARK)) | ((kind == _MARK) & (before == _LETTER)))
        mixed = np.zeros(len(starts) + 1, bool)
        mixed[np.searchsorted(starts, np.flatnonzero(kind == _OTHER), "right") - 1] = True
        turns = turns[~mixed[np.searchsorted(starts, turns, "right") - 1]]
        first = np.zeros(n + 1, bool)
        first[turns] = True
        if self.keeps_space:
            first[starts] = True
            moved = starts[(starts > 0) & (buf[starts - 1] == 32)]
            same = np.ones(n + 1, bool)
            same[edge] = False
            moved = moved[same[moved]]
            first[moved] = False
            first[moved - 1] = True
            first[:n] |= kind == _LINE
            first[edge] = True
            s = np.flatnonzero(first[:n])
            e = np.append(s[1:], n)
        else:
            first[starts] = True
            s = np.flatnonzero(first[:n])
            end = first | np.append(space, True)
            end[edge] = True
            ends = np.flatnonzero(end)
            e = ends[np.searchsorted(ends, s, "right")]
        return s, e, slow

    def encode(self, column: pa.Array, end: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, ids, bounds of the rows in ids) of one block of rows after the other. A null row counts as
        empty; every row has the id `end` behind its own."""
        whole, whole_at = text_buffer(column)
        for lo, hi in blocks(whole_at, BLOCK):
            yield lo, hi, *self._block(whole[whole_at[lo] : whole_at[hi]], whole_at[lo : hi + 1] - whole_at[lo], end)

    def _block(self, buf: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.keys) > KEPT:
            self._reset()
        s, e, slow = self._pieces(buf, at) if len(buf) else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at) - 1, bool))
        row = np.searchsorted(at, s, "right") - 1
        if slow.any():
            fast = ~slow[row]
            s, e, row = s[fast], e[fast], row[fast]
        h = hashes(buf, s, e)
        code, unique = pd.factorize(h)
        index = np.full(len(unique), -1)
        if len(self.keys):
            near = np.minimum(np.searchsorted(self.keys, unique), len(self.keys) - 1)
            index = np.where(self.keys[near] == unique, self.slots[near], -1)
        new = np.flatnonzero(index < 0)
        if len(new):
            seen = np.zeros(len(unique), np.int64)
            seen[code[::-1]] = np.arange(len(code))[::-1]
            data = buf.tobytes()
            index[new] = self._learn(unique[new], [data[a:b].decode() for a, b in zip(s[seen[new]].tolist(), e[seen[new]].tolist())])
        piece = index[code] if len(code) else np.zeros(0, np.int64)
        n = self.n[piece]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.repeat(self.start[piece] - total[:-1], n) + np.arange(total[-1])]
        ends = total[np.searchsorted(row, np.arange(len(at) - 1), "right")]
        # the ids of slow rows and the end ids go in
        more = {int(i): x for i, x in zip(np.flatnonzero(slow), self.whole([buf[at[i] : at[i + 1]].tobytes().decode() for i in np.flatnonzero(slow)]))}
        if more:
            parts, done, sizes = [], 0, np.diff(np.concatenate([[0], ends]))
            for i, x in more.items():
                parts += [ids[done : ends[i]], np.array(x, np.uint32)]
                done = ends[i]
                sizes[i] += len(x)
            ids, ends = np.concatenate([*parts, ids[done:]]), np.cumsum(sizes)
        return np.insert(ids, ends, np.uint32(end)), np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])


#: The vocabularies, and whether their ids cover white space.
KEEPS_SPACE = {"word_bpe_49k.json": False, "byte_bpe_50k.json": True}
_ready: dict[str, Encoder] = {}


def encoder(name: str, path: str | None = None) -> Encoder:
    """One for each worker process and vocabulary. path: where the file lies on the executors."""
    key = path or public_tokenizers.path(name)
    if key not in _ready:
        _ready[key] = Encoder(key, KEEPS_SPACE[name])
    return _ready[key]
