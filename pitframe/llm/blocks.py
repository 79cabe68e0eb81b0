"""Comparing all pairs within groups of any size, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Group = dict[str, np.ndarray]


#: Rows that a task holds of what its groups gave, where these can be combined.
HELD = 50_000


def _in_parts(members: DataFrame, key: str, level: Column, block: int, volume: Column | None = None, most: int = 0) -> tuple[DataFrame, DataFrame]:
    """The rows with their part, and the parts of each key and level."""
    rows = members.withColumn("_level", level.cast("int"))
    volume = F.lit(0) if volume is None else volume
    parts = rows.groupBy(key, "_level").agg(F.count("*").alias("_n"), F.sum(volume).alias("_v"))
    split = F.ceil(F.col("_n") / block) if not most else F.greatest(F.ceil(F.col("_n") / block), F.least(F.col("_n"), F.ceil(F.col("_v") / most)))
    parts = parts.withColumn("_m", split.cast("int"))
    own = rows.join(parts.select(key, "_level", "_m", "_n"), [key, "_level"])
    return own.withColumn("_part", F.pmod(F.xxhash64(key, "cls"), F.col("_m")).cast("int")), parts


def own_blocks(members: DataFrame, key: str, level: Column, block: int) -> DataFrame:
    """The blocks of :func:`pair_blocks` in which a part meets itself: each row is in one at most."""
    own, _ = _in_parts(members, key, level, block)
    here = F.struct("_level", "_part")
    return own.where("_n > 1").withColumn("block", F.xxhash64(key, here, here)).withColumn("side", F.lit(-1)).drop("_level", "_n", "_m", "_part")


def pair_blocks(members: DataFrame, key: str, level: Column, block: int, volume: Column | None = None, most: int = 0, own: bool = True) -> DataFrame:
    """The rows of ``members`` dealt so that a block holds what must be compared.

    ``members`` has the long columns ``key`` and ``cls`` (unique within a
    key).  Only rows whose integer ``level`` differs by one at most need to
    meet; the rows of a key and level are split by hash into parts of about
    ``block`` rows (and ``most`` bytes, where ``volume`` gives bytes).  Each
    pair of parts that must meet is a block, so a hot group becomes many
    blocks and every pair of rows meets in exactly one of them.  Adds
    ``block`` (names the block), ``side`` (-1: in both sides, as the part
    meets itself; 0: the lesser part; 1: the other).  Rows that meet nobody
    are left out, and without ``own`` so are the blocks of :func:`own_blocks`.
    """
    rows, parts = _in_parts(members, key, level, block, volume, most)
    rows = rows.withColumn("_other", F.explode(F.array(F.col("_level") - 1, F.col("_level"), F.col("_level") + 1)))
    met = rows.join(parts.select(F.col(key), F.col("_level").alias("_other"), F.col("_m").alias("_om")), [key, "_other"])
    met = met.where("_other <> _level or _n > 1" if own else "_other <> _level or _m > 1").withColumn("_opart", F.explode(F.sequence(F.lit(0), F.col("_om") - 1)))
    here, there = F.struct("_level", "_part"), F.struct(F.col("_other").alias("_level"), F.col("_opart").alias("_part"))
    if not own:
        met = met.where(here != there)
    return (
        met.withColumn("block", F.xxhash64(key, F.least(here, there), F.greatest(here, there)))
        .withColumn("side", F.when(here == there, -1).when(here < there, 0).otherwise(1))
        .drop("_level", "_n", "_m", "_part", "_other", "_om", "_opart")
    )


def _combined(frames: Iterator[pd.DataFrame], combine: Callable[[pd.DataFrame], pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``frames`` added up, as far as ``HELD`` rows hold them."""
    held: list[pd.DataFrame] = []
    n = 0
    for frame in frames:
        held.append(frame)
        n += len(frame)
        if n > HELD:
            whole = combine(pd.concat(held, ignore_index=True))
            held, n = [whole], len(whole)
            if n > HELD // 2:
                yield whole
                held, n = [], 0
    if held:
        yield combine(pd.concat(held, ignore_index=True))


def map_groups(
    rows: DataFrame, key: str, fn: Callable[[Group], tuple | None], schema: str, combine: Callable[[pd.DataFrame], pd.DataFrame] | None = None
) -> DataFrame:
    """``fn`` over the rows of each key, given as a dictionary of arrays.

    Rows are dealt by key and sorted within their task; a group is passed on
    once complete, so a task holds an Arrow batch and one group.  ``fn``
    returns a tuple of equally long arrays for the columns of ``schema``, or
    None; many small groups cost no more than a few large ones.  Results that
    can be added up are, within a task, by ``combine``: a frame for a frame.
    """
    names = [c.split()[0] for c in schema.split(",")]

    def done(frame: pd.DataFrame, bounds: np.ndarray) -> Iterator[pd.DataFrame]:
        cols = {c: frame[c].to_numpy() for c in frame.columns}
        out = [fn({c: v[a:b] for c, v in cols.items()}) for a, b in zip(bounds[:-1], bounds[1:])]
        if out := [x for x in out if x is not None]:
            yield pd.DataFrame({c: np.concatenate(v) for c, v in zip(names, zip(*out))})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            if frame.empty:
                continue
            keys = frame[key].to_numpy()
            starts = np.append(0, np.flatnonzero(keys[1:] != keys[:-1]) + 1)
            if held and held[-1][key].iloc[-1] != keys[0]:
                whole = pd.concat(held, ignore_index=True)
                held = []
                yield from done(whole, np.array([0, len(whole)]))
            if len(starts) > 1 and held:
                whole = pd.concat([*held, frame.iloc[: starts[1]]], ignore_index=True)
                held = []
                yield from done(whole, np.array([0, len(whole)]))
                frame, starts = frame.iloc[starts[1] :], starts[1:] - starts[1]
            if len(starts) > 1:
                yield from done(frame.iloc[: starts[-1]], starts)
                frame = frame.iloc[starts[-1] :]
            held.append(frame)
        if held:
            whole = pd.concat(held, ignore_index=True)
            yield from done(whole, np.array([0, len(whole)]))

    if combine is None:
        return rows.repartition(key).sortWithinPartitions(key).mapInPandas(run, schema)

    def added(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _combined(run(frames), combine)

    return rows.repartition(key).sortWithinPartitions(key).mapInPandas(added, schema)


def sides(group: Group) -> tuple[np.ndarray, np.ndarray]:
    """Row positions of the two sides of a block; the same array twice for a part that meets itself."""
    own = np.flatnonzero(group["side"] == -1)
    return (own, own) if len(own) else (np.flatnonzero(group["side"] == 0), np.flatnonzero(group["side"] == 1))


def local_roots(a: np.ndarray, b: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id that each of the rows ``a`` and ``b`` reaches through ``linked``."""
    top = np.iinfo(np.int64).max
    ra, rb = a.copy(), b.copy()
    while True:
        nb = np.minimum(rb, np.where(linked, ra[:, None], top).min(axis=0, initial=top))
        na = np.minimum(ra, np.where(linked, nb[None, :], top).min(axis=1, initial=top))
        if (na == ra).all() and (nb == rb).all():
            return na, nb
        ra, rb = na, nb
