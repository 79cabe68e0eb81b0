"""Large groups of near copies: what is compared in blocks grows no faster than its rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pitframe.llm import minhash


def near_copies(n: int, seed: int = 8) -> list[tuple[int, str]]:
    """Texts of which any two have a similarity of 106 / 126 or more."""
    rng = np.random.default_rng(seed)
    words = [f"q{rng.integers(10**9)}" for _ in range(120)]
    return [(i, " ".join(f"x{i}" if k == at else w for k, w in enumerate(words))) for i, at in enumerate(rng.integers(0, 120, n))]


def test_edges_of_a_large_group_grow_with_its_rows(spark, monkeypatch):
    matched, made = minhash._matched, []

    def seen(*args, **options):
        out = matched(*args, **options)
        made.append(out.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first())
        return out

    def rows_and_pairs(n: int, block: int) -> tuple[int, int]:
        made.clear()
        monkeypatch.setattr(minhash, "BUCKET_BLOCK", block)
        docs = spark.createDataFrame(near_copies(n), "doc_id long, text string")
        got = {tuple(r) for r in minhash.near_duplicates(docs).select("doc_id", "class_id", "n_links", "kept").collect()}
        assert got == {(i, 0, n - 1, i == 0) for i in range(n)}
        return sum(r[0] for r in made), sum(r[1] for r in made)

    monkeypatch.setattr(minhash, "_matched", seen)
    (small, _), (large, pairs) = rows_and_pairs(200, 8), rows_and_pairs(800, 8)
    assert large <= minhash.TREES * 800 and large <= 6 * small, (small, large)  # with the square: 16 times as many
    assert pairs == rows_and_pairs(800, 256)[1]  # all pairs are still counted, whatever the blocks


def test_blocks_of_parts_that_meet_themselves_are_just_those(spark):
    from pitframe.llm.blocks import own_blocks, pair_blocks

    rng = np.random.default_rng(6)
    rows = [(int(k), c, int(x)) for c, (k, x) in enumerate(zip(rng.integers(0, 3, 400), rng.integers(0, 5, 400)))]
    members = spark.createDataFrame(rows + [(9, 500, 1), (10, 501, 1), (10, 502, 2)], "node long, cls long, level long")
    told = lambda df: sorted(tuple(r) for r in df.select("block", "side", "node", "cls").collect())
    both = told(own_blocks(members, "node", F.col("level"), 16)) + told(pair_blocks(members, "node", F.col("level"), 16, own=False))
    whole = told(pair_blocks(members, "node", F.col("level"), 16))
    assert sorted(both) == whole and len({r[0] for r in whole if r[1] == -1}) > 15


def test_results_are_added_up_within_a_task(monkeypatch):
    import pandas as pd

    from pitframe.llm import blocks

    monkeypatch.setattr(blocks, "HELD", 8)
    add = lambda x: x.groupby("k", as_index=False)["n"].sum()
    frames = [pd.DataFrame({"k": [i % 3, i], "n": [1, 10]}) for i in range(40)]
    out = list(blocks._combined(iter(frames), add))
    assert add(pd.concat(out)).equals(add(pd.concat(frames))) and all(len(x) <= 8 + 2 for x in out) and list(blocks._combined(iter([]), add)) == []
    same = list(blocks._combined((pd.DataFrame({"k": [1], "n": [1]}) for _ in range(100)), add))
    assert len(same) == 1 and same[0]["n"].tolist() == [100]
