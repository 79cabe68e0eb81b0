"""Encoding texts by the parts between blanks, each distinct part once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct parts that a worker remembers, at most; then it starts anew.
MOST_CHUNKS = 700_000

Encoder = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


class _Codes(dict):
    """Numbers for parts, given at first sight."""

    def __missing__(self, chunk: str) -> int:
        code = self[chunk] = len(self)
        return code


def gather(codes: np.ndarray, starts: np.ndarray, lens: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The runs ``flat[starts[c] : starts[c] + lens[c]]`` for each code, one after another."""
    n = lens[codes]
    ends = np.cumsum(n)
    return flat[np.repeat(starts[codes] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


def encode_words(texts: list[str], pattern, words: Encoder) -> tuple[np.ndarray, np.ndarray]:
    """Id counts per text, and all ids, from ``words`` on the distinct matches of ``pattern``."""
    number = _Codes()
    split = [[number[w] for w in pattern.findall(t)] for t in texts]
    lens, flat = words(list(number))
    n = np.array([len(x) for x in split], np.int64)
    codes = np.fromiter((c for x in split for c in x), np.int64, int(n.sum()))
    per = np.append(0, np.cumsum(lens[codes]))
    ends = np.cumsum(n)
    return per[ends] - per[ends - n], gather(codes, np.cumsum(lens) - lens, lens, flat)


class ChunkEncoder:
    """Encodes texts through ``encode``, which takes strings and returns id counts and ids.

    It holds for encoders that never join what lies on both sides of a single
    blank between two other characters, and that encode alike wherever such a
    part stands: pre-tokenizers that put a blank before the word it leads do.
    A text is cut at its blanks; where one touches other white space, or the
    text's end, the text is encoded whole instead.
    """

    def __init__(self, encode: Encoder, most: int = MOST_CHUNKS, keep: int = 0) -> None:
        self.encode, self.most, self.keep = encode, most, keep
        self.codes, self.tables = _Codes(), [_Table(), _Table()]
        self._reset()

    def _reset(self) -> None:
        """Forgets all but the ``keep`` parts that came first, which common ones do."""
        keep = min(self.keep, len(self.codes), self.tables[1].n)
        self.codes = _Codes(islice(self.codes.items(), keep))
        self.first = _Codes()
        self.tables = [_Table(), self.tables[1].cut(keep)]

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Id counts per text, and all ids."""
        if len(self.codes) + len(self.first) > self.most:
            self._reset()
        h, t, n = self._numbered(texts)
        head, tail = self.tables
        for table, codes, lead in ((head, self.first, ""), (tail, self.codes, " ")):
            if new := table.take(codes, lead):
                table.extend(*self.encode(new))
        ends = np.cumsum(n)
        unclean = np.append(0, np.cumsum(~tail.clean[t]))
        apart = (n > 0) & (~head.clean[h] | (unclean[ends] > unclean[ends - n]))
        whole = np.flatnonzero(apart)
        if len(whole):
            h, t = np.where(apart, 0, h), t[~np.repeat(apart, n)]
        # A text is the ids of its first part and those of the others, or its own, encoded whole.
        sizes = np.zeros((len(texts), 3), np.int64)
        sizes[:, 0] = np.where(apart, 0, head.lens[h])
        per = np.append(0, np.cumsum(tail.lens[t]))
        ends = np.cumsum(np.where(apart, 0, n))
        sizes[:, 1] = per[ends] - per[ends - np.where(apart, 0, n)]
        found = [gather(h[~apart], head.starts, head.lens, head.flat), gather(t, tail.starts, tail.lens, tail.flat)]
        if len(whole):
            sizes[whole, 2], ids = self.encode([texts[i] for i in whole])
            found.append(ids)
        source = np.repeat(np.tile(np.arange(3, dtype=np.int8), len(texts)), sizes.ravel())
        out = np.empty(len(source), np.int64)
        for k, ids in enumerate(found):
            out[source == k] = ids
        return sizes.sum(1), out

    def _numbered(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the texts' first parts, of all others, and how many others each text has; each distinct part of ``texts`` is looked up once."""
        parts = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        offsets = parts.offsets.to_numpy()
        distinct = parts.flatten().dictionary_encode()
        names, at = distinct.dictionary.to_numpy(zero_copy_only=False).tolist(), distinct.indices.to_numpy()
        other = np.ones(len(at), bool)
        other[offsets[:-1]] = False
        h = np.array([self.first[names[i]] for i in at[~other]], np.int64)
        at = at[other]
        met = np.zeros(len(names), bool)
        met[at] = True
        met = np.flatnonzero(met)
        number = np.zeros(len(names), np.int64)
        number[met] = np.fromiter(map(self.codes.__getitem__, map(names.__getitem__, met.tolist())), np.int64, len(met))
        return h, number[at], np.diff(offsets).astype(np.int64) - 1


class _Table:
    """Ids of numbered parts, in arrays that grow by doubling."""

    def __init__(self) -> None:
        self.n, self.used = 0, 0
        self.starts, self.lens, self.clean = np.zeros(64, np.int64), np.zeros(64, np.int32), np.zeros(64, bool)
        self.flat = np.zeros(256, np.int32)

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.append(a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype))

    def take(self, codes: dict[str, int], lead: str) -> list[str]:
        """The parts numbered since the last call, as they are to be encoded; :meth:`extend` follows with their ids."""
        n = len(codes)
        new = list(codes)[self.n :] if n - self.n > n // 4 else _tail(codes, n - self.n)
        self.starts, self.lens, self.clean = self._room(self.starts, n), self._room(self.lens, n), self._room(self.clean, n)
        # A text's first part is encoded as it stands; a blank that leads a part may touch no other white space.
        ok = [bool(c) and (c.strip() if lead else c.rstrip()) == c for c in new]
        self.clean[self.n : n] = ok
        return [lead + c if k or not lead else "" for c, k in zip(new, ok)]

    def cut(self, n: int) -> _Table:
        """The table of the first ``n`` parts."""
        out = _Table()
        out.n, out.used = n, int(self.starts[n - 1] + self.lens[n - 1]) if n else 0
        if n:
            out.starts, out.lens, out.clean, out.flat = self.starts[:n].copy(), self.lens[:n].copy(), self.clean[:n].copy(), self.flat[: out.used].copy()
        return out

    def extend(self, counts: np.ndarray, flat: np.ndarray) -> None:
        n = self.n + len(counts)
        self.lens[self.n : n] = counts
        self.starts[self.n : n] = self.used + np.cumsum(counts) - counts
        self.flat = self._room(self.flat, self.used + len(flat))
        self.flat[self.used : self.used + len(flat)] = flat
        self.n, self.used = n, self.used + len(flat)


def _tail(codes: dict[str, int], k: int) -> list[str]:
    """The last ``k`` keys, without a walk through all."""
    keys = reversed(codes)
    return [next(keys) for _ in range(k)][::-1]


def slices(part: pd.DataFrame, chars: int = 8_000_000, rows: int = 2_000) -> Iterator[pd.DataFrame]:
    """``part``, which has ``text``, in runs of at most ``rows`` rows and about ``chars`` characters."""
    ends = part["text"].str.len().cumsum().to_numpy()
    lo = 0
    while lo < len(part):
        before = ends[lo - 1] if lo else 0
        hi = min(lo + rows, max(lo + 1, int(np.searchsorted(ends, before + chars, side="right"))))
        yield part.iloc[lo:hi]
        lo = hi
