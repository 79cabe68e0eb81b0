"""Near-duplicate vectors: spherical k-means cells, blocked cosines within them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitframe.llm.blocks import Group, local_roots, map_groups, sides
from pitframe.llm.common import cut
from pitframe.llm.components import components

COSINE = 0.95
#: Vectors that the centroids are fitted on, at most, and the most cells; both
#: bound what is broadcast.
FIT_ROWS = 50_000
MOST_CELLS = 4096
#: Vectors that a cell should hold, and those of a part of it.
CELL_ROWS = 2_000
BLOCK = 2048
#: How near the border of a later cell a vector visits it, as a share of the
#: distance within which a partner at the cosine wanted can lie beyond it.  At
#: 1 no link is lost; any less loses links.
MARGIN = 1.0


def _units(arrays: pd.Series) -> list[bytes | None]:
    """Unit vectors in double precision as bytes; None for those without a direction."""
    out: list[bytes | None] = []
    for a in arrays:
        unit = None
        if a is not None and len(a):
            v = np.array([np.nan if x is None else x for x in a], np.float64) if getattr(a, "dtype", None) == object else np.asarray(a, np.float64)
            if np.isfinite(v).all() and (top := np.abs(v).max()) > 0:
                v = v / top
                unit = (v / np.sqrt(v @ v) + 0.0).tobytes()  # one zero
        out.append(unit)
    return out


def _kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids; seeds are evenly spread rows of the sample, which is in hash order."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        home = np.concatenate([(x[i : i + 4096] @ centres.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), centres)
    return centres


def _deal(placed: DataFrame, block: int) -> DataFrame:
    """``placed`` dealt into blocks: a cell's own vectors meet each other and its guests; guests do not meet.

    A cell's own vectors and its guests are each split by hash into parts of
    about ``block`` rows, and every two parts that must meet are a block.
    """
    sizes = placed.groupBy("cell").agg(F.count_if("home").alias("_h"), F.count_if(~F.col("home")).alias("_g"))
    parts = sizes.select("cell", F.ceil(F.col("_h") / block).cast("int").alias("_mh"), F.ceil(F.col("_g") / block).cast("int").alias("_mg"))
    own = placed.join(parts, "cell").withColumn("_p", F.pmod(F.xxhash64("cls"), F.when(F.col("home"), F.col("_mh")).otherwise(F.col("_mg"))).cast("int"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    p = F.col("_p")
    entry = lambda kind, a, b, side: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), side.alias("side"))
    at_home = F.concat(
        F.transform(upto(F.col("_mh")), lambda j: entry(0, F.least(p, j), F.greatest(p, j), F.when(p == j, -1).when(p < j, 0).otherwise(1))),
        F.transform(upto(F.col("_mg")), lambda q: entry(1, p, q, F.lit(0))),
    )
    visiting = F.transform(upto(F.col("_mh")), lambda j: entry(1, j, p, F.lit(1)))
    met = own.withColumn("_e", F.explode(F.when(F.col("home"), at_home).otherwise(visiting)))
    return met.select(F.xxhash64("cell", "_e.kind", "_e.a", "_e.b").alias("block"), F.col("_e.side").alias("side"), "cls", "weight")


def _block_links(cosine: float):
    def run(group: Group) -> tuple | None:
        a, b = sides(group)
        if not len(a) or not len(b):
            return None
        x = np.frombuffer(b"".join(group["unit"]), np.float64).reshape(len(group["cls"]), -1)
        linked = x[a] @ x[b].T >= cosine
        cls = group["cls"]
        if a is b:
            np.fill_diagonal(linked, False)
        ra, rb = local_roots(cls[a], cls[b], linked)
        weight = group["weight"]
        la, lb = linked @ weight[b], linked.T @ weight[a]
        if a is b:
            u, root, links = cls[a], np.minimum(ra, rb), la
        else:
            u, root, links = np.append(cls[a], cls[b]), np.append(ra, rb), np.append(la, lb)
        found = links > 0
        return (u[found], root[found], links[found].astype(np.int64)) if found.any() else None

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE, fit_rows: int = FIT_ROWS, cell_rows: int = CELL_ROWS, margin: float = MARGIN) -> DataFrame:
    """Links between vectors whose cosine is ``cosine`` or more, in double precision.

    ``vectors`` has ``vec_id`` and ``embedding``.  Returns a row per input
    row: ``vec_id``, ``n_links`` (other rows linked directly),
    ``component_id`` (the smallest vec_id reachable) and ``kept`` (``vec_id =
    component_id``).

    Equal vectors form a class, so copies are counted and never paired.
    Spherical k-means on at most ``fit_rows`` vectors gives a cell for every
    ``cell_rows`` classes.  A vector lives in its nearest cell and visits each
    later cell whose border is nearer than ``margin`` of the sine of the largest
    angle of a link.  At the default of 1 no link is lost, whatever the cells;
    below it those are lost whose vectors differ mainly towards a border.
    A cell's vectors are compared in blocks with each other and its visitors;
    a block returns link counts and local roots, never pairs.

    A vector that is null, empty, zero, or holds null or non-finite components
    links with nothing; vectors of different lengths do not link.  Rows with a
    null vec_id are compared like others; as they have no number, they name no
    component, and are kept only where no row that they reach has one.  Rows
    that repeat a vec_id are vectors of their own.  An empty table gives an
    empty one; other columns are ignored.
    """
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be above 0 and at most 1")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))

    def units(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"vec_id": part["vec_id"], "unit": _units(part["embedding"])})

    unit = cut(rows.mapInPandas(units, "vec_id long, unit binary").select("*", F.sha2("unit", 256).alias("key"), F.monotonically_increasing_id().alias("rid")))
    # A class is named by a row of it, as ids may repeat with other vectors.
    classes = cut(unit.where("unit is not null").groupBy("key").agg(
        F.min("rid").alias("cls"), F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("unit").alias("unit")
    ).withColumn("uid", F.xxhash64("key")))
    n = classes.count()
    sample = classes.orderBy("uid", "key").limit(fit_rows).select("unit").collect()
    lengths: dict[int, list[bytes]] = {}
    for r in sample:
        lengths.setdefault(len(r["unit"]), []).append(r["unit"])
    centres = {}  # by length; a length outside the sample has one cell
    for length, own in lengths.items():
        k = max(1, min(MOST_CELLS, len(own) // 8, -(-n * len(own) // (len(sample) * cell_rows))))
        centres[length] = _kmeans(np.frombuffer(b"".join(own), np.float64).reshape(len(own), -1), k)
    shared = vectors.sparkSession.sparkContext.broadcast(centres)  # fit_rows / 8 rows at most
    reach = margin * float(np.sqrt(max(0.0, 1 - cosine * cosine))) + 1e-9

    def cells(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gaps = {length: np.sqrt(np.maximum(0, 2 - 2 * c @ c.T)) for length, c in shared.value.items()}
        for part in parts:
            length_of = part["unit"].str.len()
            for length, alike in part.groupby(length_of):
                for lo in range(0, len(alike), 2048):
                    own = alike.iloc[lo : lo + 2048]
                    if length not in gaps:
                        home, row, cell = np.zeros(len(own), np.int64), np.empty(0, int), np.empty(0, int)
                    else:
                        near = np.frombuffer(b"".join(own["unit"]), np.float64).reshape(len(own), -1) @ shared.value[length].T
                        home = near.argmax(axis=1)
                        behind = near[np.arange(len(own)), home][:, None] - near
                        visits = behind <= reach * gaps[length][home] + 1e-9
                        visits &= np.arange(near.shape[1])[None, :] > home[:, None]
                        row, cell = np.nonzero(visits)
                    at = np.append(np.arange(len(own)), row)
                    yield pd.DataFrame({
                        "cell": int(length) * (MOST_CELLS << 8) + np.append(home, cell).astype(np.int64), "home": np.append(np.ones(len(own), bool), np.zeros(len(row), bool)),
                        "cls": own["cls"].to_numpy()[at], "weight": own["weight"].to_numpy()[at],
                    })

    placed = cut(classes.select("cls", "weight", "unit").mapInPandas(cells, "cell long, home boolean, cls long, weight long"))
    blocks = _deal(placed, BLOCK).join(classes.select("cls", "unit"), "cls").select("block", "side", "cls", "weight", "unit")
    links = cut(map_groups(blocks, "block", _block_links(cosine), "cls long, root long, links long"))
    counts = links.groupBy("cls").agg(F.sum("links").alias("links"))
    roots = components(links.select(F.col("cls").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "cls")
    known = cut(
        classes.select("key", "cls", "least", "weight").join(counts, "cls", "left").join(roots, "cls", "left")
        .where("weight > 1 or links is not null").withColumn("root", F.coalesce("root", "cls"))
    )
    known = known.join(known.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("key", "component_id", "weight", "links")
    found = unit.select("vec_id", "key").join(known, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return found.select(
        "vec_id",
        (F.coalesce("weight", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, component.isNull()).alias("kept"),
    )
