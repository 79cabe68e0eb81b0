"""Near-duplicate join on n-gram Jaccard similarity by a MinHash LSH forest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitframe.llm.blocks import Group, local_roots, map_groups, own_blocks, pair_blocks, sides
from pitframe.llm.common import cut, without_ids
from pitframe.llm.components import components

WORDS = 5
THRESHOLD = 0.8
#: Trees of the forest, and minhash values that a tree's path is made of.
TREES = 16
DEPTH = 8
#: The share of pairs at the threshold itself that must share a prefix.
RECALL = 0.9995
#: Values of a signature that lie outside one tree, and the pairs at the threshold that are assumed unseen.
OTHERS = (TREES - 1) * DEPTH
UNSEEN = 10
#: Rows of a part of a node, and of a part of a candidate group.
BUCKET_BLOCK = 256
GROUP_BLOCK = 256
GROUP_BYTES = 8_000_000
#: Representatives whose ids may be broadcast to fetch their texts.
BROADCAST_ROWS = 200_000

_MULT = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_MULT), -1, 2**64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the multiplier and of its inverse, as far as asked for."""

    def __init__(self) -> None:
        self.n, self.up, self.down = 0, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 2 * self.n)
            one = np.ones(1, np.uint64)
            self.up = np.cumprod(np.append(one, np.full(self.n, _MULT)), dtype=np.uint64)
            self.down = np.cumprod(np.append(one, np.full(self.n, _INVERSE)), dtype=np.uint64)
        return self.up, self.down


_POWERS = _Powers()


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words of the lower-cased text.

    Words are parted by blanks and control characters.  A text of fewer words
    has one shingle, all of it; one without words has none.
    """
    data = np.frombuffer((text or "").lower().encode("utf-8", "replace"), np.uint8)
    blank = data <= 32
    # One blank after each word, none before the first.
    data = np.append(data[~blank | np.append(True, ~blank[:-1])[: len(blank)]], np.uint8(32))
    blank = data <= 32
    if len(data) and blank[0]:
        data, blank = data[1:], blank[1:]
    if len(data) > 1 and blank[-2]:
        data, blank = data[:-1], blank[:-1]
    ends = np.flatnonzero(blank)
    if not len(ends):
        return np.empty(0, np.uint64)
    starts = np.append(0, ends[:-1] + 1)
    up, down = _POWERS.to(len(data))
    sums = np.append(np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64))
    if len(ends) >= words:
        starts, ends = starts[: len(ends) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    return np.unique(_mix((sums[ends] - sums[starts]) * down[starts]))


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20_011))
    return rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """A row of ``n`` 16-bit minhashes for each non-empty set."""
    sizes = np.array([len(s) for s in sets])
    flat, starts = np.concatenate(sets), np.cumsum(sizes) - sizes
    out = np.empty((len(sets), n), np.uint16)
    for i, (a, b) in enumerate(zip(*_permutations(n))):
        out[:, i] = _mix(np.minimum.reduceat(flat * a + b, starts)) >> np.uint64(48)
    return out


def _hashes(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set, 0 for an empty one."""
    h1, h2 = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
    for i, s in enumerate(sets):
        if len(s):
            h1[i], h2[i] = np.bitwise_xor.reduce(_mix(s)).view(np.int64), _mix(s + _MULT).sum(dtype=np.uint64).view(np.int64)
    return h1, h2


def sketch(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, h1, h2, size, sig`` of every row: the set's hash, its size, its forest paths."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for lo in range(0, len(part), 256):
                texts = part["text"].iloc[lo : lo + 256]
                sets = [shingles(t, words) for t in texts]
                full = [i for i, s in enumerate(sets) if len(s)]
                (h1, h2), sig = _hashes(sets), np.full(len(sets), None, object)
                if full:
                    sig[full] = [row.tobytes() for row in signatures([sets[i] for i in full], TREES * DEPTH)]
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].iloc[lo : lo + 256].to_numpy(), "h1": h1, "h2": h2, "size": np.array([len(s) for s in sets], np.int32), "sig": sig,
                })

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, h1 long, h2 long, size int, sig binary")


def prefix_depth(threshold: float, recall: float) -> int:
    """The first depth, from the deepest, at which pairs at the threshold itself meet with the recall wanted."""
    depth = DEPTH
    while depth > 1 and 1 - (1 - threshold**depth) ** TREES < recall:
        depth -= 1
    return depth


def shortened(histogram: dict[int, dict[int, int]], threshold: float, recall: float) -> dict[int, int]:
    """A depth for each level of set sizes, from the pairs that full-depth prefixes brought together.

    ``histogram`` counts, by level and by agreement of the values outside the
    tree that brought a pair together, how often pairs met.  A pair of
    similarity s meets in ``TREES * s**DEPTH`` trees on average, which gives
    the number of pairs of each similarity; the deepest prefix that is
    expected to miss no more than ``1 - recall`` of them is taken.
    ``UNSEEN`` more pairs at the threshold itself are assumed, so that a level
    with few pairs has the depth that suits the threshold.
    """
    least = prefix_depth(threshold, recall)
    out = {}
    for level, seen in histogram.items():
        share = np.array([min(1.0, k / OTHERS) for k in seen])
        pairs = np.array(list(seen.values())) / (TREES * np.maximum(share, 1e-9) ** DEPTH)
        share, pairs = np.append(share[share >= threshold], threshold), np.append(pairs[share >= threshold], UNSEEN)
        missed = lambda d: float((pairs * (1 - share**d) ** TREES).sum() / pairs.sum())  # noqa: B023, E731
        out[level] = next((d for d in range(DEPTH, least, -1) if missed(d) <= 1 - recall), least)
    return out


def _linked_signatures(threshold: float, counted: bool):
    """Of a node of a tree: edges of pairs whose signatures agree as often as pairs at the threshold may, and how often they agree.

    Edges are a spanning forest of the roots that the block connects, so what
    is known to be connected gives none.  Agreements are ``counted`` of all
    pairs of classes.
    """
    least = max(0.0, threshold - 4.5 * (threshold * (1 - threshold) / OTHERS) ** 0.5) * OTHERS

    def run(group: Group) -> tuple | None:
        a, b = sides(group)
        if not len(a) or not len(b):
            return None
        sig = np.frombuffer(b"".join(group["sig"]), np.uint16).reshape(-1, TREES * DEPTH)
        own = np.arange(TREES * DEPTH) // DEPTH == group["tree"][0]
        sig = sig[:, ~own]
        size, root = group["size"], group["root"]
        sa, sb = size[a][:, None], size[b][None, :]
        near = np.minimum(sa, sb) >= threshold * np.maximum(sa, sb) - 1e-9
        name = group["cls"] if counted else root
        near &= name[a][:, None] != name[b][None, :]
        if not near.any():
            return None
        if len(a) * len(b) <= 4096:
            same = (sig[a][:, None, :] == sig[b][None, :, :]).sum(axis=2)
        else:
            same = np.zeros(near.shape, np.uint8)
            for x, y in zip(sig[a].T, sig[b].T):
                same += x[:, None] == y[None, :]
        near &= same >= least
        i, j = np.nonzero(near)
        if not len(i):
            return None
        roots, place = np.unique(root, return_inverse=True)
        linked = np.eye(len(roots), dtype=bool)
        linked[place[a[i]], place[b[j]]] = True
        low, _ = local_roots(roots, roots, linked | linked.T)
        moved = low != roots
        u, v = roots[moved], low[moved]
        kinds = n = np.empty(0, np.int64)
        if counted:
            level = np.minimum(group["level"][a[i]], group["level"][b[j]]).astype(np.int64)
            kinds, n = np.unique(level * 256 + same[i, j], return_counts=True)
            if a is b:
                n = n // 2  # each pair stands twice
        none, edge = np.zeros(len(kinds), np.int64), np.zeros(len(u), np.int64)
        return np.append(u, none), np.append(v, none), np.append(edge - 1, kinds), np.append(edge, n)

    return run


def intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of ``a`` with all of ``b``."""
    na, nb = [len(s) for s in a], [len(s) for s in b]
    values, col = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    ca, cb = col[: sum(na)], col[sum(na) :]
    ra, rb = np.repeat(np.arange(len(a)), na), np.repeat(np.arange(len(b)), nb)
    both = np.zeros(len(values), np.int8)
    both[ca] |= 1
    both[cb] |= 2
    shared = np.flatnonzero(both == 3)
    place = np.full(len(values), -1)
    place[shared] = np.arange(len(shared))
    ca, cb = place[ca], place[cb]
    (ra, ca), (rb, cb) = (ra[ca >= 0], ca[ca >= 0]), (rb[cb >= 0], cb[cb >= 0])
    out = np.zeros((len(a), len(b)), np.float32)
    for lo in range(0, len(shared), 4096):
        width = min(4096, len(shared) - lo)
        ma, mb = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
        for m, r, c in ((ma, ra, ca), (mb, rb, cb)):
            own = (c >= lo) & (c < lo + width)
            m[r[own], c[own] - lo] = 1
        out += ma @ mb.T
    return out


def _verified(threshold: float):
    """Exact similarities within a block: weighted links and a local root per row."""

    def run(group: Group) -> tuple | None:
        a, b = sides(group)
        if not len(a) or not len(b):
            return None
        sets = [np.frombuffer(x, np.uint64) for x in group["grams"]]
        size = np.array([len(s) for s in sets], np.float64)
        meet = intersections([sets[i] for i in a], [sets[i] for i in b]).astype(np.float64)
        linked = meet >= threshold * (size[a][:, None] + size[b][None, :] - meet) - 1e-9
        cls, weight = group["cls"], group["weight"]
        own = a is b
        if own:
            np.fill_diagonal(linked, False)
        ra, rb = local_roots(cls[a], cls[b], linked)
        la, lb = linked @ weight[b], linked.T @ weight[a]
        if own:
            u, root, links = cls[a], np.minimum(ra, rb), la
        else:
            u, root, links = np.append(cls[a], cls[b]), np.append(ra, rb), np.append(la, lb)
        found = links > 0
        return (u[found], root[found], links[found].astype(np.int64)) if found.any() else None

    return run


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, recall: float = RECALL) -> DataFrame:
    """Groups of documents whose word n-gram sets have a Jaccard similarity of ``threshold`` or more.

    Returns a row per input row: ``doc_id``, ``class_id`` (the smallest doc_id
    reachable by links), ``n_links`` (other rows linked directly, copies
    included) and ``kept`` (``doc_id = class_id``).

    Rows with the same set form a class, so copies are counted and never
    paired.  A class has a path of ``DEPTH`` values in each of ``TREES`` prefix
    trees; a node is a tree, a depth and a prefix, and its members are compared
    by signature, in blocks, which leaves one edge per class and block.  First
    prefixes of the full depth are matched.  The similarities of the pairs
    found tell, for each level of set sizes, what share of links that depth
    misses, and the documents of the level shorten their prefixes until the
    wanted recall is met (:func:`shortened`); shorter prefixes then join only
    what is not yet known to be connected.  Connected classes form candidate groups, and
    within these all pairs are verified exactly on their sets of n-grams, again
    in blocks.  No pair is ever a row.

    Texts that are null, empty or blank link with nothing.  A text of fewer
    than ``words`` words is one shingle.  A row with a null doc_id is returned
    with a null class and no links, and is kept.  Rows that repeat a doc_id
    are documents of their own: each is compared by its own text.  An empty
    table gives an empty one; other columns are ignored.
    """
    return _linked(docs, threshold, words, recall).drop("h1", "h2")


def _nodes(classes: DataFrame, depths: Column) -> DataFrame:
    """``tree, node`` of each class at each of its ``depths``."""
    spread = classes.select("cls", "root", "size", "level", "sig", F.explode(F.array_distinct(depths)).alias("depth"))
    spread = spread.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))))
    return spread.select("cls", "root", "size", "level", "tree", F.xxhash64("tree", "depth", F.substring("sig", F.col("tree") * (2 * DEPTH) + 1, 2 * F.col("depth"))).alias("node"))


def _met(nodes: DataFrame) -> DataFrame:
    """The rows of nodes in which several roots meet."""
    full = nodes.groupBy("node").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).where("_a <> _b").select("node")
    return nodes.join(full, "node")


def _matched(blocks: DataFrame, classes: DataFrame, threshold: float, counted: bool = False) -> DataFrame:
    """``u, v, kind, n``: edges between roots (kind -1) and counts of agreements of the pairs that blocks of nodes bring together."""
    met = blocks.drop("node").join(classes.select("cls", "sig"), "cls").select("block", "side", "cls", "root", "size", "level", "tree", "sig")
    add = lambda x: x.groupby(["u", "v", "kind"], as_index=False)["n"].sum()
    return cut(map_groups(met, "block", _linked_signatures(threshold, counted), "u long, v long, kind long, n long", add))


def _with_roots(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """``classes`` with a ``root`` that ``edges`` lead to, three steps far: who shares it is connected."""
    low = edges.groupBy(F.col("u").alias("cls")).agg(F.min("v").alias("root"))
    further = low.select(F.col("cls").alias("root"), F.col("root").alias("_next"))
    for _ in range(2):
        low = low.join(further, "root", "left").select("cls", F.coalesce("_next", "root").alias("root"))
    return classes.join(low, "cls", "left").withColumn("root", F.coalesce("root", "cls"))


def _candidates(classes: DataFrame, threshold: float, recall: float) -> DataFrame:
    """``node, root``: classes connected by pairs that the forest brings together.

    The parts of a node meet themselves first, which gives an edge at most for
    each class and tree; where parts then meet each other, or shorter prefixes
    are matched, only what is not yet known to be connected gives edges.  So
    edges grow with the classes, though a large group's blocks grow with its
    square.
    """
    nodes = cut(_met(_nodes(classes.withColumn("root", F.col("cls")), F.array(F.lit(DEPTH)))))
    matched = _matched(own_blocks(nodes, "node", F.col("level"), BUCKET_BLOCK), classes, threshold, True)
    nodes = _with_roots(nodes.drop("root"), matched.where("kind < 0"))
    matched = matched.unionByName(_matched(pair_blocks(nodes, "node", F.col("level"), BUCKET_BLOCK, own=False), classes, threshold, True))
    edges = matched.where("kind < 0").select("u", "v")
    histogram: dict[int, dict[int, int]] = {}
    for r in matched.where("kind >= 0").groupBy("kind").agg(F.sum("n").alias("n")).collect():  # levels of size by shares: some thousands at most
        histogram.setdefault(r["kind"] // 256, {})[r["kind"] % 256] = r["n"]
    chosen, least = shortened(histogram, threshold, recall), prefix_depth(threshold, recall)
    if any(chosen.get(level, least) < DEPTH for level in [*chosen, None]):
        of_level = F.create_map(*[F.lit(x) for pair in chosen.items() for x in pair]) if chosen else F.create_map().cast("map<int,int>")
        depth = lambda level: F.coalesce(F.try_element_at(of_level, level.cast("int")), F.lit(least))
        # A pair meets at the lesser of its two depths, so a document is at its neighbours' depths too.
        depths = F.array(depth(F.col("level") - 1), depth(F.col("level")), depth(F.col("level") + 1))
        nodes = _met(_nodes(cut(_with_roots(classes, edges)), depths))
        edges = edges.unionByName(_matched(pair_blocks(nodes, "node", F.col("level"), BUCKET_BLOCK), classes, threshold).select("u", "v"))
    return components(edges)


def _gram_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """``doc_id, h1, h2, grams`` of the rows of ``docs`` whose id is in ``ids``."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for lo in range(0, len(part), 256):
                sets = [shingles(t, words) for t in part["text"].iloc[lo : lo + 256]]
                h1, h2 = _hashes(sets)
                yield pd.DataFrame({"doc_id": part["doc_id"].iloc[lo : lo + 256].to_numpy(), "h1": h1, "h2": h2, "grams": [x.tobytes() for x in sets]})

    few = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(few, "doc_id").select("doc_id", "text")
    return own.mapInPandas(run, "doc_id long, h1 long, h2 long, grams binary")


def _linked(docs: DataFrame, threshold: float, words: int, recall: float) -> DataFrame:
    """As :func:`near_duplicates`, with the hashes ``h1, h2`` of each row's set."""
    rows = cut(sketch(docs, words).withColumn("rid", F.monotonically_increasing_id()))
    level = F.floor(F.log(F.col("size")) / F.lit(-np.log(threshold))).cast("int")
    # A class is named by a row of it, as ids may repeat with other texts.
    classes = cut(rows.where("size > 0 and doc_id is not null").groupBy("h1", "h2").agg(
        F.min("rid").alias("cls"), F.min("doc_id").alias("least"), F.count("*").alias("weight"), F.first("size").alias("size"), F.first("sig").alias("sig")
    ).withColumn("level", level))
    found = _candidates(classes, threshold, recall)
    groups = cut(found.join(classes.select(F.col("cls").alias("node"), "least", "weight", "size", "level", "h1", "h2"), "node"))

    members = groups.select(F.col("root").alias("grp"), F.col("node").alias("cls"), "weight", "size", "level")
    blocks = pair_blocks(members, "grp", F.col("level"), GROUP_BLOCK, 8 * F.col("size"), GROUP_BYTES).select("block", "side", "cls", "weight")
    wanted = groups.select(F.col("least").alias("doc_id"), "h1", "h2", F.col("node").alias("cls"))
    grams = _gram_sets(docs, cut(wanted.select("doc_id").distinct()), words).join(wanted, ["doc_id", "h1", "h2"]).groupBy("cls").agg(F.first("grams").alias("grams"))
    links = cut(map_groups(blocks.join(grams, "cls"), "block", _verified(threshold), "cls long, root long, links long"))
    counts = links.groupBy("cls").agg(F.sum("links").alias("links"))
    roots = components(links.select(F.col("cls").alias("u"), F.col("root").alias("v")))
    known = cut(
        classes.select("h1", "h2", "cls", "least", "weight").join(counts, "cls", "left").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
        .where("weight > 1 or links is not null").withColumn("root", F.coalesce("root", "cls"))
    )
    known = known.join(known.groupBy("root").agg(F.min("least").alias("class_id")), "root").select("h1", "h2", "class_id", "weight", "links", F.lit(True).alias("ok"))
    own = rows.select("doc_id", "h1", "h2", (F.expr("size > 0 and doc_id is not null")).alias("ok")).join(known, ["h1", "h2", "ok"], "left")
    return own.select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        (F.coalesce("weight", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce(F.col("doc_id") == F.coalesce("class_id", "doc_id"), F.lit(True)).alias("kept"),
        "h1", "h2",
    )


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the near duplicates of a document with a smaller doc_id.

    Rows with a null doc_id stay.  Of rows that repeat a doc_id each text is
    judged by itself, and one row of each set of n-grams (of each text, where
    it has no words) stays.
    """
    found = cut(_linked(docs, threshold, WORDS, RECALL))
    dropped = found.where("not kept").select("doc_id").distinct()
    repeated = cut(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if not repeated.take(1):
        return without_ids(docs, dropped, BROADCAST_ROWS)

    @F.pandas_udf("struct<h1: long, h2: long, full: boolean>")
    def own(texts: pd.Series) -> pd.DataFrame:
        sets = [shingles(t) for t in texts]
        h1, h2 = _hashes(sets)
        return pd.DataFrame({"h1": h1, "h2": h2, "full": [len(s) > 0 for s in sets]})

    many = docs.join(repeated, "doc_id").withColumn("_own", own("text"))
    many = many.select(*docs.columns, F.col("_own.h1").alias("_h1"), F.col("_own.h2").alias("_h2"), F.when(~F.col("_own.full"), F.col("text")).alias("_blank"))
    kept = found.where("kept").select("doc_id", F.col("h1").alias("_h1"), F.col("h2").alias("_h2")).distinct()
    many = many.join(kept, ["doc_id", "_h1", "_h2"]).dropDuplicates(["doc_id", "_h1", "_h2", "_blank"]).select(*docs.columns)
    return without_ids(docs, dropped.unionByName(repeated).distinct(), BROADCAST_ROWS).unionByName(many)
