"""Byte-level BPE by tree concatenation: halves are encoded apart, then mended at their joins.

An encoding by merges is right as soon as each two neighbouring tokens are
what their own text encodes to.  So two right encodings ``a`` and ``b`` of the
halves of a word are put together by encoding a window of some last tokens of
``a`` and first ones of ``b`` anew: where the window's first and last token
are those that stood there, all that lies outside stays right.  Otherwise the
window grows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitframe.llm.bitpack import _encoder
from pitframe.llm.chunks import slices

#: Characters of a leaf, which is encoded in one go, and of a piece, which is dealt to a task of its own, at most.
LEAF = 2_048
PIECE = 32_768
#: Behind such a letter, and before such another character, a word ends whatever stands around them.
_EDGE = re.compile("[A-Za-zÀ-ÖØ-öø-ÿΑ-Ρα-ωА-яぁ-ゖァ-ヺ一-龥가-힣](?=[\x00-@\\[-`{-\x7f、。，])")


class TreeBpe:
    """A worker's encoder.  ``joins``, ``grown`` and ``anew`` count joins, windows that had to grow, and words encoded afresh."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.leaves = _encoder(path)
        self.tok = Tokenizer.from_file(path)
        self.split = self.tok.pre_tokenizer.pre_tokenize_str
        self.merge = self.tok.model.tokenize
        added = self.tok.get_added_tokens_decoder()
        self.added = {t.content: i for i, t in added.items()}
        self.cuts = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        letters = _byte_letters()
        byte_of = {c: b for b, c in letters.items()}
        self.letters = "".join(letters[b] for b in range(256))
        n = max(self.tok.get_vocab(with_added_tokens=True).values()) + 1
        self.pieces = np.full(n, b"", object)
        for token, i in self.tok.get_vocab(with_added_tokens=True).items():
            known = all(c in byte_of for c in token)
            self.pieces[i] = bytes(byte_of[c] for c in token) if known else token.encode()
        self.size = np.array([len(p) for p in self.pieces], np.int64)
        self.names = np.array([str(i).encode() for i in range(n)], object)
        self.joins = self.grown = self.anew = 0

    def _word(self, data: bytes) -> np.ndarray:
        """The ids of one word, by merges alone."""
        return np.array([t.id for t in self.merge(data.decode("latin-1").translate(self.letters))], np.int32)

    def _covering(self, ids: np.ndarray, size: int, last: bool) -> int:
        """How many tokens, first or last, make up ``size`` bytes."""
        k = min(len(ids), 64)
        while True:
            ends = np.cumsum(self.size[ids[len(ids) - k :][::-1] if last else ids[:k]])
            if size == 0 or k == len(ids) or ends[-1] >= size:
                return int(np.searchsorted(ends, size)) + 1 if size else 0
            k = min(len(ids), 4 * k)

    def _inside(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ids of a word from those of its two parts: windows grow on the side that does not agree."""
        left = right = 1
        while True:
            left, right = min(left, len(a)), min(right, len(b))
            window = self._word(b"".join(self.pieces[np.append(a[len(a) - left :], b[:right])]))
            left_ok = left == len(a) or window[0] == a[-left]
            right_ok = right == len(b) or window[-1] == b[right - 1]
            if left_ok and right_ok:
                return np.concatenate([a[: len(a) - left], window, b[right:]])
            self.grown += 1
            left, right = left * (1 if left_ok else 2), right * (1 if right_ok else 2)

    def join(self, text: str, lo: int, mid: int, hi: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ids of ``text[lo:hi]`` from ``a``, those of ``text[lo:mid]``, and ``b``, those of ``text[mid:hi]``.

        Words that are the same with and without the cut keep their tokens.
        """
        self.joins += 1
        start, end = _edge_before(text, lo, mid), _edge_after(text, mid, hi)
        old_a = [(start + x, start + y) for _, (x, y) in self.split(text[start:mid])]
        old_b = [(mid + x, mid + y) for _, (x, y) in self.split(text[mid:end])]
        new = [(start + x, start + y) for _, (x, y) in self.split(text[start:end])]
        i = 0
        while i < min(len(new), len(old_a)) and new[i] == old_a[i]:
            i += 1
        j = 0
        while j < min(len(new) - i, len(old_b)) and new[-1 - j] == old_b[-1 - j]:
            j += 1
        new, old_a, old_b = new[i : len(new) - j], old_a[i:], old_b[: len(old_b) - j]
        if not new:
            return np.concatenate([a, b])
        k = self._covering(a, len(text[new[0][0] : mid].encode("utf-8", "replace")), True) if old_a else 0
        m = self._covering(b, len(text[mid : new[-1][1]].encode("utf-8", "replace")), False) if old_b else 0
        if len(new) == len(old_a) == len(old_b) == 1:
            inner = self._inside(a[len(a) - k :], b[:m])
        else:  # the cut changed where words part
            self.anew += len(new)
            inner = np.concatenate([self._word(text[x:y].encode("utf-8", "replace")) for x, y in new])
        return np.concatenate([a[: len(a) - k], inner, b[m:]])

    def tree(self, text: str, found: Iterator[np.ndarray], size: int) -> np.ndarray:
        """The ids of ``text`` from those of its leaves of at most ``size`` characters, in order."""

        def build(lo: int, hi: int) -> np.ndarray:
            if hi - lo <= size:
                return next(found)
            mid = middle(text, lo, hi)
            a = build(lo, mid)
            return self.join(text, lo, mid, hi, a, build(mid, hi))

        return build(0, len(text))

    def sections(self, text: str) -> list[str]:
        """The text between added tokens, and these, in turn: every other one is an added token."""
        return self.cuts.split(text) if self.cuts else [text]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as the library gives them without special tokens."""
        parts = [self.sections(t) for t in texts]
        spans = [s[lo:hi] for p in parts for s in p[::2] for lo, hi in leaves(s, LEAF)]
        counts, ids = self.leaves(spans)
        found = iter(np.split(ids.astype(np.int32), np.cumsum(counts)[:-1]))
        return [self.put_together([self.tree(s, found, LEAF) for s in p[::2]], p[1::2]) for p in parts]

    def put_together(self, ids: list[np.ndarray], added: list[str]) -> np.ndarray:
        """The sections' ids with the added tokens between them."""
        out = [ids[0]]
        for token, own in zip(added, ids[1:]):
            out += [np.array([self.added[token]], np.int32), own]
        return np.concatenate(out)

    def decode(self, ids: np.ndarray) -> bytes:
        """The UTF-8 form of the text of ``ids``; bytes that are no text become U+FFFD, ids of no token nothing."""
        ids = ids[(ids >= 0) & (ids < len(self.pieces))]
        return b"".join(self.pieces[ids]).decode("utf-8", "replace").encode()

    def ids_text(self, ids: np.ndarray) -> bytes:
        return b",".join(self.names[ids])


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def middle(text: str, lo: int, hi: int) -> int:
    """Where to halve ``text[lo:hi]``: not beside white space, if that can be had within a few characters, as leaves that begin or end with words cost less."""
    mid = (lo + hi) // 2
    for x in range(mid, min(mid + 32, hi - 1)):
        if not (text[x - 1].isspace() or text[x].isspace()):
            return x
    return mid


def leaves(text: str, size: int) -> list[tuple[int, int]]:
    """The spans of at most ``size`` characters that halving ends at."""
    out, todo = [], [(0, len(text))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= size:
            out.append((lo, hi))
        else:
            mid = middle(text, lo, hi)
            todo += [(mid, hi), (lo, mid)]
    return out


def _edge_before(text: str, lo: int, mid: int) -> int:
    """The last sure end of a word in ``text[lo:mid]``, or ``lo``; looks back in growing steps."""
    step = 32
    while True:
        at = max(lo, mid - step)
        found = None
        for found in _EDGE.finditer(text, at, mid):
            pass
        if found or at == lo:
            return found.end() if found else lo
        step *= 4


def _edge_after(text: str, mid: int, hi: int) -> int:
    found = _EDGE.search(text, mid, hi)
    return found.end() if found else hi


@lru_cache(maxsize=2)
def worker(path: str) -> TreeBpe:
    return TreeBpe(path)


Finish = Callable[[TreeBpe, list, list[np.ndarray]], pd.DataFrame]


def _encoded(docs: DataFrame, path: str, finish: Finish, schema: str) -> DataFrame:
    """``finish`` on every document's ids: in one task for texts up to ``PIECE`` characters, from pieces dealt over tasks for longer ones.

    A longer text's pieces are named by its digest, so equal rows are encoded
    once; all its ids meet in one row at the end, which the result asks for.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def short(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = worker(path)
        for part in parts:
            for own in slices(part, chars=4_000_000):
                yield finish(bpe, own["doc_id"].tolist(), bpe.encode(own["text"].tolist()))

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = worker(path)
        for part in parts:
            for doc_id, text in zip(part["doc_id"], part["text"]):
                digest = hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()
                found = [(i, j, s[lo:hi]) for i, s in enumerate(bpe.sections(text)) for j, (lo, hi) in enumerate([(0, len(s))] if i % 2 else leaves(s, PIECE))]
                for at in range(0, len(found), 64):
                    section, piece, own = zip(*found[at : at + 64])
                    yield pd.DataFrame({"doc_id": pd.array([None if pd.isna(doc_id) else doc_id] * len(own), "Int64"), "digest": digest, "section": section, "piece": piece, "text": own})

    def encode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = worker(path)
        for part in parts:
            for own in slices(part, chars=4_000_000):
                inner = [t if s % 2 == 0 else "" for s, t in zip(own["section"], own["text"])]
                yield own.assign(ids=[x.tobytes() for x in bpe.encode(inner)])

    def mend(own: pd.DataFrame) -> pd.DataFrame:
        bpe = worker(path)
        own = own.sort_values(["section", "piece"])
        ids, added = [], []
        for s, part in own.groupby("section"):
            text = "".join(part["text"])
            if s % 2:
                added.append(text)
            else:
                ids.append(bpe.tree(text, iter([np.frombuffer(x, np.int32) for x in part["ids"]]), PIECE))
        n = int(own["copies"].iloc[0])
        return finish(bpe, [own["doc_id"].iloc[0]] * n, [bpe.put_together(ids, added)] * n)

    is_long = F.length("text") > PIECE
    pieces = rows.where(is_long).mapInPandas(cut, "doc_id long, digest string, section int, piece int, text string")
    dealt = pieces.groupBy("doc_id", "digest", "section", "piece").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    done = dealt.mapInPandas(encode, "doc_id long, digest string, section int, piece int, text string, copies long, ids binary")
    return rows.where(~is_long).mapInPandas(short, schema).unionByName(done.groupBy("doc_id", "digest").applyInPandas(mend, schema))


def _longs(values: list) -> pd.Series:
    return pd.Series(pd.array([None if pd.isna(v) else int(v) for v in values], "Int64"))


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids`` of every text by the tokenizer file at ``path``, without special tokens.

    A null text is an empty one, with no ids; an added token's string in a text
    is that token.  A row for each row, repeated or with a null ``doc_id``
    alike; an empty table gives none; other columns are ignored.  Whole texts
    are encoded: of a long one, pieces go to several tasks.
    """
    return _encoded(docs, path, lambda _, doc_ids, ids: pd.DataFrame({"doc_id": _longs(doc_ids), "ids": ids}), "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` of rows ``doc_id, ids``, special tokens kept.

    Null ids, or none, give an empty text; an id or a null that names no token
    gives nothing, and bytes that are no text become U+FFFD.  A row for each
    row; other columns are ignored.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = worker(path)
        for part in parts:
            texts = [bpe.decode(np.array([] if ids is None else [-1 if pd.isna(i) else i for i in ids], np.int64)).decode() for ids in part["ids"]]
            yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "text": texts})

    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return rows.mapInPandas(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every text, encoded and decoded again.

    Nulls, repeats, long texts, empty tables and other columns are as in
    :func:`encode_documents`; an empty text has the digests of no bytes.
    """

    def finish(bpe: TreeBpe, doc_ids: list, found: list[np.ndarray]) -> pd.DataFrame:
        return pd.DataFrame({
            "doc_id": _longs(doc_ids), "n_tokens": [len(x) for x in found],
            "ids_sha256": [hashlib.sha256(bpe.ids_text(x)).hexdigest() for x in found],
            "decoded_sha256": [hashlib.sha256(bpe.decode(x)).hexdigest() for x in found],
        })

    return _encoded(docs, path, finish, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
