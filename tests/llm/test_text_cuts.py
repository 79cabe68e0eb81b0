"""Tree concatenation, conversation repair and fill-in-middle: brute force, the libraries, odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pitframe.llm import repair, skiplist, treebpe
from pitframe.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
BITS = ["a", "b", "ab", "the", " ", "  ", "\n", "\n\n", "'", "'s", "'re", "'ll", "1", "23", "é", "ß", "汉", "字", "。", "!", "...", "_", "\t", " ", " ", "\U0001f600", "<|endoftext|>", "<|endof", "x" * 9, "aaaa", "\x1c", "\x85", "́", "ⅷ", "᠎", "ing", "=="]
DOCS = "doc_id long, text string"


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def odd(spark):
    rnd = random.Random(8)
    long = "".join(rnd.choice(BITS) for _ in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a<|endoftext|><|endoftext|> b"), (5, long), (5, long), (None, long), (None, None), (6, "x\u0000y z \U0001f600 é"), (7, "q" * 150_000), (7, "other"), (8, "中" * 40_000), (9, "a" * 40_000 + "<|endoftext|>" + " b" * 30_000)]
    return spark.createDataFrame(rows, DOCS)


def test_joins_at_any_place_agree_with_the_library(library, monkeypatch):
    monkeypatch.setattr(treebpe, "LEAF", 5)
    bpe, rnd = treebpe.TreeBpe(PATH), random.Random(5)
    for _ in range(1_500):
        some = rnd.sample(BITS, rnd.choice([2, 4, 8, len(BITS)]))
        text = "".join(rnd.choice(some) for _ in range(rnd.choice([3, 10, 40, 120])))
        want = library.encode(text, add_special_tokens=False).ids
        assert bpe.encode([text])[0].tolist() == want, text
        assert bpe.decode(np.array(want)).decode() == library.decode(want, skip_special_tokens=False)
    assert bpe.grown and bpe.anew  # windows grew, and words were split anew


def test_windows_grow_until_both_sides_agree(library, monkeypatch):
    monkeypatch.setattr(treebpe, "LEAF", 64)
    bpe, rnd = treebpe.TreeBpe(PATH), random.Random(6)
    for alphabet in ("ab", "aaab", "abcdefgh", "的一是", "=-"):
        text = "".join(rnd.choice(alphabet) for _ in range(3_000))
        assert bpe.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
    assert bpe.encode(["a" * 5_000])[0].tolist() == library.encode("a" * 5_000, add_special_tokens=False).ids
    assert bpe.joins > 100 and bpe.grown


def test_decoding_of_ids_that_are_no_text(library):
    bpe, rnd = treebpe.TreeBpe(PATH), random.Random(7)
    for _ in range(300):
        ids = [rnd.randrange(50_257) for _ in range(20)]
        assert bpe.decode(np.array(ids)).decode() == library.decode(ids, skip_special_tokens=False)


def test_tree_digests(spark, sf_dir, library):
    got = {r["doc_id"]: r for r in QUERIES["op11_treebpe"](spark, sf_dir).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    assert got.keys() == texts.keys()
    for i, e in zip(texts, library.encode_batch(list(texts.values()), add_special_tokens=False)):
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(e.ids), sha(",".join(map(str, e.ids))))
        assert got[i]["decoded_sha256"] == sha(library.decode(e.ids, skip_special_tokens=False))


def test_trees_of_odd_rows(spark, odd, library):
    other = odd.select("*", *[F.lit("other").alias(c) for c in ("ids", "digest", "section", "piece", "copies", "n_tokens")])
    want = []
    for r in odd.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(r["text"] or "")))
    for df in (odd, other):
        assert sorted(map(tuple, treebpe.digests(df, PATH).collect()), key=str) == sorted(want, key=str)
    encoded = treebpe.encode_documents(odd, PATH)
    back = treebpe.decode_documents(encoded, PATH).collect()
    assert sorted(map(tuple, back), key=str) == sorted([(r["doc_id"], r["text"] or "") for r in odd.collect()], key=str)
    assert treebpe.digests(odd.limit(0), PATH).count() == 0 and treebpe.encode_documents(odd.limit(0), PATH).count() == 0
    none = spark.createDataFrame([(1, None), (2, []), (3, [None, -1, 60_000, 64])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in treebpe.decode_documents(none, PATH).collect()} == {1: "", 2: "", 3: "a"}


def units(text: str) -> list[str]:
    return re.findall(r"(?s)[A-Za-z]+|[^A-Za-z]", text)


def test_skip_lists_reach_every_rank(monkeypatch):
    rnd = random.Random(2)
    for stretch, span in ((7, 2), (3, 3), (1 << 20, 16), (1, 4)):
        monkeypatch.setattr(skiplist, "STRETCH", stretch)
        monkeypatch.setattr(skiplist, "SPAN", span)
        for _ in range(150):
            text = "a" * rnd.choice([0, 0, 30]) + "".join(rnd.choice(["a", "B", "z", " ", "1", "é", "\n", "\U0001f600", "[", "`", "{", "@", "Z"]) for _ in range(rnd.randrange(60)))
            own = units(text)
            found = skiplist.SkipList(np.concatenate([np.empty(0, np.uint32), *skiplist.unit_lengths(text)]))
            assert found.n == len(own)
            assert [found.offset(k) for k in range(len(own) + 1)] == [sum(map(len, own[:k])) for k in range(len(own) + 1)]
    with pytest.raises(IndexError):
        found.offset(found.n + 1)


def by_hand(doc_id, text: str) -> tuple:
    h = sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    own = units(text)
    n = len(own)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(own[:lo]), "".join(own[lo:hi]), "".join(own[hi:])
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, form, len(p), len(m), sha(out), sha(text)


def test_fill_in_middle(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = [tuple(r) for r in QUERIES["op13_fim"](spark, sf_dir).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256").collect()]
    assert sorted(got) == sorted(by_hand(r["doc_id"], r["text"] or "") for r in rows)
    assert {g[2] for g in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_of_odd_rows(spark, odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()] + [(i, t) for i in range(20, 40) for t in ("a<", "<P", "<<S", "a<P>b", "<M><S>", "z", "\U0001f600")]
    df = spark.createDataFrame(rows, DOCS).select("*", F.lit(1).alias("n"), F.lit(1).alias("form"), F.lit(1).alias("done"))
    got = [tuple(r) for r in skiplist.digests(df).collect()]
    assert sorted(got, key=str) == sorted([by_hand(i, t or "") for i, t in rows], key=str)
    back = skiplist.restore_documents(skiplist.fill_in_middle(df)).collect()
    assert sorted(map(tuple, back), key=str) == sorted([(i, t or "") for i, t in rows], key=str)
    assert skiplist.digests(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        skiplist.restore("<P>a<S>b", "psm")


def brute_audit(initials, truncated, doomed) -> tuple[int, str]:
    """All edits of bounded cost, row by row: every state's least cost and audit, relaxed until nothing changes."""
    nxt, keep = {0: 2, 1: 2, 2: 3, 3: 2}, {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    best, todo = {(0, 0): (0, "")}, [(0, 0)]
    while todo:
        i, q = todo.pop()
        c, a = best[i, q]
        edges = [((i, nxt[q]), "I", 2)]
        if i < len(initials):
            edges.append(((i + 1, q), "D", 3))
            if not doomed[i]:
                edges.append(((i + 1, nxt[q]), "R", 2 + truncated[i]))
                if (q, initials[i]) in keep:
                    edges.append(((i + 1, keep[q, initials[i]]), "K", int(truncated[i])))
        for to, e, more in edges:
            if (c + more, a + e) < best.get(to, (99_999, "")):
                best[to] = (c + more, a + e)
                todo.append(to)
    return min(best[len(initials), q] for q in (0, 3) if (len(initials), q) in best)


def test_searches_from_both_ends_meet_at_the_least_audit():
    rnd = random.Random(3)
    for _ in range(1_500):
        n = rnd.randrange(9)
        initials = [rnd.choice(["s", "u", "u", "a", "a", "x", " ", ""]) for _ in range(n)]
        doomed = [rnd.random() < 0.2 for _ in initials]
        truncated = [rnd.random() < 0.3 and not d for d in doomed]
        grid = repair.Lattice(initials, truncated, doomed)
        got = grid.cheapest(0, (0, 3))
        assert got == brute_audit(initials, truncated, doomed)
        lines, state = repair.apply(got[1], 0, initials, [""] * n)
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines)) and state in (0, 3)


def repaired_by_hand(rows: list[tuple]) -> dict:
    """The contract, in plain Python, for rows ``conv_id, turn, role, text``."""
    after = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = after[conv]
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        own += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    out = {}
    for conv, own in after.items():
        own.sort(key=lambda r: ((r[0] is not None, r[0] or 0), r[1].encode(), r[2].encode()))
        turns = {r[0] for r in own if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        faults, seen = [], set()
        for _, role, text in own:
            white = "\x20\x09\x0a\x0b\x0c\x0d"
            faults.append("blank" if not text.strip(white) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(white)[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[1][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = brute_audit(initials, [f == "truncated" for f in faults], [f in ("blank", "duplicate") for f in faults])
        lines, i = [], 0
        for e in audit:
            last = lines[-1][0] if lines else ""
            if e == "I":
                lines.append("assistant:" if last == "u" else "user:")
                continue
            if e != "D":
                lines.append(f"{own[i][1] if e == 'K' else 'assistant' if last == 'u' else 'user'}:{own[i][2]}")
            i += 1
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha("\n".join(lines)))
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def found(df) -> dict:
    rows = df.collect()
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(got) == len(rows)
    return got


def test_repair(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(QUERIES["op12_repair"](spark, sf_dir)) == repaired_by_hand(rows)


def talk(rnd: random.Random, conv, n: int) -> list[tuple]:
    roles, words = ["user", "assistant", "system", "tool", "", None, "User", "unknown"], ["Yes.", "no", " \t", "", None, "Why?", "so ", "a ", " ", "x.\n", "y!", "long one."]
    weights = [6, 6, 1, 1, 0.3, 0.3, 0.3, 0.3]
    return [(conv, rnd.choice([None, *range(n)]) if rnd.random() < 0.3 else i, rnd.choices(roles, weights)[0], rnd.choice(words) if rnd.random() < 0.6 else f"w{i}.") for i in range(n)]


def test_repair_of_odd_and_long_conversations(spark):
    rnd = random.Random(11)
    rows = [r for conv in [*range(40), None] for r in talk(rnd, conv, rnd.randrange(1, 12))]
    rows += talk(rnd, 100, 130) + talk(rnd, 101, 70) + [(102, 5, "user", "same.")] * 90 + [(102, i, "assistant", "same.") for i in range(60)] + [(103, None, None, None)] * 50
    rows += [(None, i, "user", f"n{i}") for i in range(60)]
    drop = next(i for i in range(1000, 2000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows += [(drop, 0, "user", "gone.")]
    want = repaired_by_hand(rows)
    assert want[drop] == (0, 0, 0, 0, 0, 0, "", sha(""))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    other = df.select("*", *[F.lit("other").alias(c) for c in ("n", "cost", "audit", "long_id", "digest", "copy")])
    assert found(repair.conversations(other)) == want
    for block in (1, 7, 25):  # the same, when conversations are long
        assert found(repair.repair(repair.damaged(df), block)) == want, block
    lines = {r["conv_id"]: r for r in repair.repaired(repair.damaged(df)).collect()}
    for conv, x in want.items():
        assert (lines[conv]["audit"], sha("\n".join(lines[conv]["lines"]))) == (x[6], x[7])
    assert repair.conversations(df.limit(0)).count() == 0
