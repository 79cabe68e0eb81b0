"""Recall of the n-gram join against an exact join of 10,000 documents."""

from __future__ import annotations

from collections import Counter, defaultdict

from pitframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def exact_links(sets: list[frozenset]) -> list[tuple[int, int]]:
    """Pairs of distinct sets with a Jaccard similarity of 0.8 or more: such sets share one of their rarest members.

    Of two sets so alike, at least four fifths of either are shared, so the
    first fifth and one more of each, by rareness, have a member in common.
    """
    seen = Counter(x for s in sets for x in s)
    holders, links = defaultdict(list), []
    for i in sorted(range(len(sets)), key=lambda i: len(sets[i])):
        own = sorted(sets[i], key=lambda x: (seen[x], x))
        first = own[: len(own) - -(-4 * len(own) // 5) + 1]
        for j in {j for x in first for j in holders[x]}:
            if 5 * len(sets[j]) >= 4 * len(sets[i]):
                both = len(sets[i] & sets[j])
                if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                    links.append((i, j))
        for x in first:
            holders[x].append(i)
    return links


def test_recall_on_ten_thousand_documents(spark):
    ids: dict[frozenset, list[int]] = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toLocalIterator():
        words = (r["text"] or "").lower().split()
        grams = frozenset(hash(tuple(words[k : k + 5])) for k in range(max(1, len(words) - 4))) if words else frozenset()
        if grams:
            ids[grams].append(r["doc_id"])
    sets = list(ids)
    near = exact_links(sets)
    want = Counter()
    for s in sets:
        for x in ids[s]:
            want[x] += len(ids[s]) - 1
    for i, j in near:
        for a, b in ((i, j), (j, i)):
            for x in ids[sets[a]]:
                want[x] += len(ids[sets[b]])
    got = {r["doc_id"]: r["n_links"] for r in QUERIES["op9_minhash"](spark, SF).select("doc_id", "n_links").collect()}
    assert all(n <= want[x] for x, n in got.items())  # none that is not one
    ends, met = sum(want.values()), sum(got.values())
    print(f"link ends wanted {ends}, found {met}; links between different texts {len(near)}")
    assert ends > 3000 and len(near) > 40  # most links of these tables are between copies
    assert met >= 0.999 * ends
