from __future__ import annotations

import numpy as np

from pitframe.llm.chunks import ChunkEncoder, _Codes


def _letters(texts):
    return np.array([len(t) for t in texts], np.int64), np.array([ord(c) for t in texts for c in t], np.int32)


def test_each_distinct_part_is_looked_up_once_and_first_parts_go_apart():
    """First parts have no blank before them; among the others they would keep those from going to the library joined."""
    looked, calls = [], []

    class Counted(_Codes):
        def __getitem__(self, part):
            looked.append(part)
            return super().__getitem__(part)

    enc = ChunkEncoder(lambda xs: calls.append(xs) or _letters(xs))
    enc.codes = Counted()
    texts = ["a b c b c b", "b c c c", "", "d  c", "c\n b", "b c\n", "é b"]
    for _ in range(2):
        counts, ids = enc(texts)
        assert ["".join(map(chr, x)) for x in np.split(ids, np.cumsum(counts)[:-1])] == texts
    assert len(looked) == 2 * len(set(looked))  # once in each call
    fresh = [c for c in calls if not set(c) <= set(texts)]
    assert sum(any(t[:1] == " " for t in c) for c in fresh) == 1
    assert not any(t and t[0] != " " for c in fresh if any(t[:1] == " " for t in c) for t in c)


def test_empty_calls():
    counts, ids = ChunkEncoder(_letters)([])
    assert len(counts) == len(ids) == 0
    counts, ids = ChunkEncoder(_letters)(["", " ", "  "])
    assert counts.tolist() == [0, 1, 2] and ids.tolist() == [32] * 3
