"""Byte-level BPE by recursive DuckDB queries, run within each partition."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitframe.llm.chunks import ChunkEncoder, encode_words, slices

#: Bytes of distinct words, and of long ones, in one recursive query, and ids in one decoding query, about.
WORD_BYTES = 500_000
LONG_BYTES = 200_000
DECODE_IDS = 500_000
#: Rounds of one recursive query, at most; the rows of all its rounds are held.
ROUNDS = 8
#: Above every rank.
_TOP = 1 << 30

#: Words up to this length are contracted pair by pair, longer ones many pairs at a time.
SHORT = 32

#: A token row is a word, the place ``e`` where it ends among all words' bytes
#: (a gap parts words), its id, the next token's id and its length.  A round
#: joins each row whose pair is new with the merge table, takes each word's
#: least rank, the leftmost of equals (``key``: rank, place, length, in one
#: number), drops the pair's left row, and gives the merged id to the right
#: one, and to the row before as its next token.
_CONTRACT_SHORT = """
with recursive s(w, e, tok, nt, len, key, fresh, live) as (
  select w, e, tok, nt, len, null::bigint, true, true from tokens
  union all
  (with p as (
     select s.w, e, tok, nt, len, case when fresh then (m.r::bigint << 40) + (e << 8) + len else key end as key
     from s left join ranked m on m.pair = case when fresh then tok::bigint * 65536 + nt end where live),
   b as (select w, min(key) as best from p where key is not null group by w),
   q as (select p.*, best, coalesce(e - len = (best >> 8) & 4294967295, false) as grows, coalesce(e = ((best >> 8) & 4294967295) - (best & 255), false) as before
         from p left join b on b.w = p.w where key is null or best is null or key <> best)
   select w, e, case when grows then (best >> 40)::int else tok end, case when before then (best >> 40)::int else nt end,
     case when grows then len + (best & 255) else len end, key, grows or before, best is not null
   from q)
)
select w, e - len as g, tok from s where not live order by g
"""

#: Long words: a row has the place ``g`` of its first byte.  A round contracts
#: each word's leftmost pair of the least rank, and with it every pair B C that
#: must come to be contracted whatever happens around it (A before, D after):
#:
#: * no earlier merge can take C (with D, or with what D may grow to) or B
#:   (with A, or with what A may grow to): ``lowr`` is the least rank of a merge
#:   of the left token with a token that begins as the right one does, ``lowl``
#:   that of a merge of a token that ends as the left one does; in a run of
#:   pairs of one rank nothing grows from the right unless it does at its end;
#: * the merged token opens no merge of a lower rank (``calm`` is 2 where it
#:   never can; at 1 its pairs with A and D are looked up; at 0 it waits);
#: * of overlapping pairs of one rank every other one, from the leftmost on.
#:
#: Pairs that are not found safe wait until they are their word's least.
_CONTRACT_LONG = """
with recursive s(w, g, tok, len, live, round) as (
  select w, g, tok, len, true, 0 from tokens
  union all
  (with adjacent as (
     select n.*, m.r, m.calm, coalesce(m.lowr, 1073741824) as lowr, coalesce(m.lowl, 1073741824) as lowl
     from (select w, g, tok, len, round, case when lead(g) over o = g + len then lead(tok) over o end as nt, lead(len) over o as nlen
           from s where live and round < {rounds} window o as (order by g)) n
     left join merges m on m.pair = n.tok::bigint * 65536 + n.nt),
   beside as (
     select *, row_number() over o as i, lag(g) over o as before, lag(r) over o as r_before, lead(r) over o as r_after,
       coalesce(lag(r) over o > r, true) as a_later, coalesce(lag(lowl, 2) over o > r, true) as a_kept,
       coalesce(lag(lowl) over o > r or lag(lowl, 2) over o > r, true) as a_stays,
       coalesce(lead(r) over o >= r, true) as d_later, coalesce(lead(lowr, 2) over o >= r, true) as d_kept,
       coalesce(lead(lowr) over o >= r or lead(lowr, 2) over o >= r, true) as d_stays,
       case when calm = 1 and lag(nt) over o is not null then (lag(tok) over o)::bigint * 65536 + r end as on_left,
       case when calm = 1 then r::bigint * 65536 + lead(nt) over o end as on_right
     from adjacent window o as (order by g)),
   ends as (
     select * replace (d_stays or run_stays as d_stays, d_kept or run_stays as d_kept) from (
       select *, coalesce(lead(r) over o = r and lead(upto) over o % 2 = 1, false) as run_stays from (
         select *, min(case when r is not null and coalesce(r_after <> r, true) then i * 2 + (d_later and d_stays)::int end) over (order by g rows between current row and unbounded following) as upto
         from beside) window o as (order by g))),
   apart as (
     select b.*, coalesce(b.calm > 0, false) and d_later and d_stays and coalesce(y.r > b.r, true) and (coalesce(y.lowr > b.r, true) or d_kept) as safe,
       a_later and a_stays and coalesce(x.r > b.r, true) and (coalesce(x.lowl > b.r, true) or a_kept) as first
     from ends b left join opened x on x.pair = b.on_left left join opened y on y.pair = b.on_right),
   starts as (
     select *, coalesce(lag(safe) over o, false) as safe_before,
       case when safe and not coalesce(lag(safe) over o and r_before = r, false) then i * 2 + first::int end as start
     from apart window o as (order by g)),
   runs as (
     select *, max(start) over (order by g rows unbounded preceding) as run, max(start) over (order by g rows between unbounded preceding and 1 preceding) as run_before
     from starts),
   best as (select w, min(r::bigint << 32 | g) as k from adjacent where r is not null group by w)
   select w, g, case when hit then r else tok end, case when hit then len + nlen else len end, k is not null, round + 1
   from (select runs.*, best.k,
       coalesce(k = (r::bigint << 32 | g) or (safe and run % 2 = 1 and (i - run // 2) % 2 = 0), false) as hit,
       coalesce(k = (r_before::bigint << 32 | before) or (safe_before and run_before % 2 = 1 and (i - 1 - run_before // 2) % 2 = 0), false) as gone
     from runs left join best on best.w = runs.w)
   where not gone)
)
select w, g, tok, len, live from s where not live or round = {rounds} order by g
"""

_DECODE = "select d, string_agg(piece, '' order by pos) as text from ids_of_documents join pieces using (tok) group by d"


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a vocabulary file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """``pair, r, calm, lowr, lowl`` of every pair of neighbours that bears on a merge."""
    name = {rank: token for token, rank in ranks.items()}
    rank_of: dict[tuple[int, int], int] = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                rank_of[a, b] = rank
    opens: dict[int, int] = {}  # the least rank of a merge that a token is part of
    lowr: dict[tuple[int, int], int] = {}
    lowl: dict[tuple[int, int], int] = {}
    for (a, b), r in rank_of.items():
        opens[a], opens[b] = min(opens.get(a, _TOP), r), min(opens.get(b, _TOP), r)
        t = name[b]
        for i in range(1, len(t) + 1):
            if (d := ranks.get(t[:i])) is not None and lowr.get((a, d), _TOP) > r:
                lowr[a, d] = r
        t = name[a]
        for i in range(len(t)):
            if (d := ranks.get(t[i:])) is not None and lowl.get((d, b), _TOP) > r:
                lowl[d, b] = r

    def calm(pair: tuple[int, int]) -> int:
        r = rank_of.get(pair)
        if r is None or rank_of.get((r, r), _TOP) < r:
            return 0
        return 2 if opens.get(r, _TOP) > r else 1

    keys = list(lowr.keys() | lowl.keys())
    column = lambda of: pa.array([of(k) for k in keys], pa.int32())
    return pa.table({
        "pair": pa.array([a * 65536 + b for a, b in keys], pa.int64()), "r": column(rank_of.get), "calm": column(calm),
        "lowr": column(lambda k: lowr.get(k, _TOP)), "lowl": column(lambda k: lowl.get(k, _TOP)),
    })


class DuckBpe:
    """A worker's connection with the vocabulary's tables, one thread, no files."""

    def __init__(self, path: str, pattern: str) -> None:
        import duckdb
        import regex

        ranks = read_ranks(path)
        if max(ranks.values()) >= 65536:
            raise ValueError("the merge table holds ids below 65536")
        self.whole = ranks
        self.pattern = regex.compile(pattern)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        inner = np.unique(np.concatenate([np.frombuffer(t[:-1], np.uint8) * np.int64(256) + np.frombuffer(t[1:], np.uint8) for t in ranks if len(t) > 1]))
        self.has_token = np.zeros(65536, bool)
        self.has_token[list(ranks.values())] = True
        self.joins = np.zeros(65536, bool)  # neighbouring bytes that some token holds
        self.joins[inner] = True
        self.memory = 0
        self.db = duckdb.connect(config={"threads": 1})
        self.db.execute("set temp_directory = ''")
        self.db.execute("set preserve_insertion_order = false")
        self._room(WORD_BYTES)
        self._load("merges", merge_table(ranks))
        self.db.execute("create table ranked as select pair, r from merges where r is not null")
        self.db.execute("create table opened as select pair, r, lowr, lowl from merges where pair >> 16 in (select r from merges where calm = 1) or pair & 65535 in (select r from merges where calm = 1)")
        self._load("pieces", pa.table({"tok": pa.array(ranks.values(), pa.int32()), "piece": [t.decode("latin-1") for t in ranks]}))
        self.texts = ChunkEncoder(self.encode)

    def _room(self, n: int) -> None:
        """Memory for queries over ``n`` bytes of words: more only where one word is longer than a query's share."""
        if (mb := max(400, n // 1_500)) > self.memory:
            self.memory = mb
            self.db.execute(f"set memory_limit = '{mb}MB'")

    def _load(self, name: str, data: pa.Table) -> None:
        self.db.register("loaded", data)
        self.db.execute(f"create table {name} as select * from loaded")
        self.db.unregister("loaded")

    def _rows(self, name: str, data: pa.Table, query: str) -> pa.Table:
        self.db.register(name, data)
        try:
            return self.db.sql(query).to_arrow_table()
        finally:
            self.db.unregister(name)

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Id counts per word, and all ids.  A word that is a token is that token, as in ``tiktoken``."""
        counts = np.ones(len(words), np.int64)
        known = np.array([self.whole.get(w, -1) for w in words], np.int64)
        rest = np.flatnonzero(known < 0)
        sizes = np.array([len(words[i]) for i in rest], np.int64)
        found, at = [], 0
        while at < len(rest):
            to = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), WORD_BYTES)) + at)
            per, ids = self._contract([words[i] for i in rest[at:to]])
            counts[rest[at:to]] = per
            found.append(ids)
            at = to
        ids = np.empty(int(counts.sum()), np.int32)
        alone = np.zeros(len(ids), bool)
        alone[(np.cumsum(counts) - counts)[known >= 0]] = True
        ids[alone] = known[known >= 0]
        ids[~alone] = np.concatenate([np.empty(0, np.int32), *found])
        return counts, ids

    def _contract(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Id counts per word, and all ids, by recursive queries.

        A word is parted where no token holds the two bytes that meet, as no
        merge crosses such a place.
        """
        data = np.frombuffer(b"".join(words), np.uint8)
        size = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(size)
        starts = np.append(True, ~self.joins[data[:-1] * np.int64(256) + data[1:]])
        starts[ends - size] = True
        firsts = np.flatnonzero(starts)
        lengths = np.diff(np.append(firsts, len(data)))
        place = np.arange(len(data), dtype=np.int64) + np.cumsum(starts) - 1
        g, tok = [], []
        for long in (False, True):
            own = np.repeat((lengths > SHORT) == long, lengths)
            if own.any():
                found = (self._long if long else self._short)(np.cumsum(starts[own]) - 1, place[own], self.of_byte[data[own]])
                g.append(found[0])
                tok.append(found[1])
        g, tok = np.concatenate(g), np.concatenate(tok)
        order = np.argsort(g, kind="stable")
        word = np.searchsorted(ends, np.arange(len(data)), side="right")
        return np.bincount(word[np.searchsorted(place, g[order])], minlength=len(words)), tok[order]

    def _short(self, part: np.ndarray, place: np.ndarray, tok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and ids of the tokens of short words."""
        last = np.append(part[1:] != part[:-1], True)
        tokens = pa.table({
            "w": part.astype(np.int32), "e": place + 1, "tok": tok, "nt": pa.array(np.append(tok[1:], 0), pa.int32(), mask=last), "len": np.ones(len(tok), np.int64),
        })
        out = self._rows("tokens", tokens, _CONTRACT_SHORT)
        return out["g"].to_numpy(), out["tok"].to_numpy()

    def _long(self, part: np.ndarray, place: np.ndarray, tok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and ids of the tokens of long words; a query runs a bounded number of rounds, and the next goes on from there."""
        sizes = np.bincount(part)
        if len(tok) > LONG_BYTES and len(sizes) > 1:  # several words: no query holds more than its share, or one word
            half = max(1, int(np.searchsorted(np.cumsum(sizes), len(tok) // 2)))
            own = part < half
            first, second = self._long(part[own], place[own], tok[own]), self._long(part[~own] - half, place[~own], tok[~own])
            return np.concatenate([first[0], second[0]]), np.concatenate([first[1], second[1]])
        self._room(len(tok))
        tokens = pa.table({"w": part, "g": place, "tok": tok, "len": np.ones(len(tok), np.int32)})
        query = _CONTRACT_LONG.format(rounds=max(1, min(ROUNDS, 8 * LONG_BYTES // len(tok))))
        done, ids = [], []
        while tokens.num_rows:
            out = self._rows("tokens", tokens, query)
            live = out["live"].to_numpy()
            done.append(out["g"].to_numpy()[~live])
            ids.append(out["tok"].to_numpy()[~live])
            tokens = out.filter(pa.array(live)).drop_columns(["live"])
        return np.concatenate(done), np.concatenate(ids)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Id counts per text, and all ids; each distinct word is contracted once."""
        return encode_words(texts, self.pattern, lambda found: self.words([w.encode("utf-8", "replace") for w in found]))

    def decode(self, counts: np.ndarray, ids: np.ndarray) -> list[bytes]:
        """The bytes of each document's ids, put in order by the aggregation; an id without a token is an error."""
        if len(ids) and (ids.min() < 0 or ids.max() >= 65536 or not self.has_token[ids].all()):
            raise ValueError("an id that is no token's")
        out: list[bytes] = []
        ends, at = np.cumsum(counts), 0
        while at < len(counts):
            begin = int(ends[at] - counts[at])
            to = max(at + 1, int(np.searchsorted(ends, begin + DECODE_IDS)))
            own = ids[begin : int(ends[to - 1])]
            d = np.repeat(np.arange(to - at, dtype=np.int32), counts[at:to])
            rows = self._rows("ids_of_documents", pa.table({"d": d, "pos": np.arange(len(own), dtype=np.int64), "tok": own.astype(np.int32)}), _DECODE)
            texts = dict(zip(rows["d"].to_pylist(), rows["text"].to_pylist()))
            out += [texts.get(i, "").encode("latin-1") for i in range(to - at)]
            at = to
        return out


@lru_cache(maxsize=2)
def _worker(path: str, pattern: str) -> DuckBpe:
    return DuckBpe(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids`` of every text, without special tokens; a null text is an empty one, with no ids.

    A row for each row, repeated or with a null ``doc_id`` alike; other columns
    are ignored.  Whole texts are encoded; a word without a blank of a million
    letters takes seconds, as rounds do not grow with its length.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = _worker(path, pattern)
        for part in parts:
            for own in slices(part):
                counts, ids = bpe.texts(own["text"].tolist())
                yield pd.DataFrame({"doc_id": own["doc_id"], "ids": np.split(ids.astype(np.int32), np.cumsum(counts)[:-1])})

    return _texts(docs).mapInPandas(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids, bytes`` of rows ``doc_id, ids``; null ids are none, and other columns are ignored.

    An id that names no token fails the job, as there is nothing right to put
    in its place.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = _worker(path, pattern)
        for part in parts:
            for lo in range(0, len(part), 500):
                own = part.iloc[lo : lo + 500]
                held = [np.empty(0, np.int32) if x is None else x for x in own["ids"]]
                counts = np.array([len(x) for x in held], np.int64)
                ids = np.concatenate([np.empty(0, np.int32), *held]).astype(np.int32)
                yield pd.DataFrame({"doc_id": own["doc_id"], "ids": own["ids"], "bytes": bpe.decode(counts, ids)})

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInPandas(run, "doc_id long, ids array<int>, bytes binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every text, encoded and decoded again.

    Encoding and decoding share a pass, so ids stay within their task.  Nulls,
    repeats, long texts and other columns are as in :func:`encode_documents`;
    an empty text has the digests of no bytes.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = _worker(path, pattern)
        for part in parts:
            for own in slices(part):
                counts, ids = bpe.texts(own["text"].tolist())
                data, ends = ids.astype("<u4").tobytes(), 4 * np.cumsum(counts)
                yield pd.DataFrame({
                    "doc_id": own["doc_id"], "n_tokens": counts,
                    "ids_sha256": [hashlib.sha256(data[e - 4 * n : e]).hexdigest() for e, n in zip(ends, counts)],
                    "decoded_sha256": [hashlib.sha256(b).hexdigest() for b in bpe.decode(counts, ids)],
                })

    return _texts(docs).mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
