"""Conversation structure repair: the cheapest edits, by Dijkstra's search from both ends of an edit lattice."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitframe.llm.common import scratch

#: Rows of a conversation, or of a block of a longer one, that a task searches at once, at most.
BLOCK = 1_000
#: Rows of a side that may be broadcast.
FEW = 100_000
WHITE = "\x20\t\n\x0b\x0c\r"
DELETE, INSERT, REROLE = 3, 2, 2
#: What roles came so far: none, ``s`` alone, one that ends with ``u``, or with ``a``.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
#: The state that the next user or assistant leads to, and the role it has.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: The initial that may be kept in a state, and where it leads.
KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}

Node = tuple[int, int]
Label = tuple[int, str]


@dataclass
class Lattice:
    """Nodes are rows passed and a state; edges are edits."""

    initials: Sequence[str]
    truncated: Sequence[bool]
    doomed: Sequence[bool]

    def onward(self, node: Node) -> Iterator[tuple[Node, str, int]]:
        """Edges out of a node: where to, the edit's initial, its cost."""
        i, q = node
        if i < len(self.initials):
            yield (i + 1, q), "D", DELETE
            if not self.doomed[i]:
                more = int(self.truncated[i])
                if (kept := KEEP.get((q, self.initials[i]))) is not None:
                    yield (i + 1, kept), "K", more
                yield (i + 1, NEXT[q]), "R", REROLE + more
        yield (i, NEXT[q]), "I", INSERT

    def back(self, node: Node) -> Iterator[tuple[Node, str, int]]:
        """Edges into a node: where from, the edit's initial, its cost."""
        i, q = node
        before = [p for p in STATES if NEXT[p] == q]
        if i:
            yield (i - 1, q), "D", DELETE
            if not self.doomed[i - 1]:
                more = int(self.truncated[i - 1])
                for p in STATES:
                    if KEEP.get((p, self.initials[i - 1])) == q:
                        yield (i - 1, p), "K", more
                for p in before:
                    yield (i - 1, p), "R", REROLE + more
        for p in before:
            yield (i, p), "I", INSERT

    def cheapest(self, begin: int, ends: Sequence[int]) -> Label | None:
        """Cost and audit of the best path from state ``begin`` to one of ``ends``; of equal costs the least audit.

        Both searches settle nodes by cost.  They go on until their next costs
        together exceed the best crossing, so every crossing of that cost has
        been met; of these, the least audit is the answer.  Within a cost,
        nodes go by rows passed, so that a label is final when its node is
        settled.
        """
        n = len(self.initials)
        label: tuple[dict[Node, Label], dict[Node, Label]] = ({(0, begin): (0, "")}, {(n, q): (0, "") for q in ends})
        heaps = [[(0, 0, begin)], [(0, 0, q) for q in ends]]
        settled: tuple[set[Node], set[Node]] = (set(), set())
        best: Label | None = None
        while heaps[0] and heaps[1] and (best is None or heaps[0][0][0] + heaps[1][0][0] <= best[0]):
            side = int(heaps[1][0][0] < heaps[0][0][0])
            own, other = label[side], label[1 - side]
            cost, passed, q = heapq.heappop(heaps[side])
            node = (n - passed if side else passed, q)
            if node in settled[side] or own[node][0] < cost:
                continue
            settled[side].add(node)
            audit = own[node][1]
            if node in other:
                best = _less(best, self._crossing(node, label))
            for to, edit, more in self.back(node) if side else self.onward(node):
                found = (cost + more, edit + audit if side else audit + edit)
                if to not in own or found < own[to]:
                    known = own.get(to)
                    own[to] = found
                    if known is None or found[0] < known[0]:
                        heapq.heappush(heaps[side], (found[0], n - to[0] if side else to[0], to[1]))
                    if to in settled[1 - side]:
                        best = _less(best, self._crossing(to, label))
        # A side that has run dry has settled all it can reach; the other's labels on it are weighed above.
        return best

    @staticmethod
    def _crossing(node: Node, label: tuple[dict[Node, Label], dict[Node, Label]]) -> Label:
        (c, prefix), (d, suffix) = label[0][node], label[1][node]
        return c + d, prefix + suffix


def _less(a: Label | None, b: Label | None) -> Label | None:
    return b if a is None else a if b is None else min(a, b)


def apply(audit: str, state: int, roles: Sequence[str], texts: Sequence[str]) -> tuple[list[str], int]:
    """The repaired ``role:text`` lines of the rows by an audit, and the state after them."""
    lines, i = [], 0
    for edit in audit:
        if edit == "I":
            state = NEXT[state]
            lines.append(f"{ROLE[state]}:")
            continue
        if edit == "K":
            state = KEEP[state, roles[i][:1]]
            lines.append(f"{roles[i]}:{texts[i]}")
        elif edit == "R":
            state = NEXT[state]
            lines.append(f"{ROLE[state]}:{texts[i]}")
        i += 1
    return lines, state


def is_blank(text: str) -> bool:
    return not text.strip(WHITE)


def is_truncated(text: str) -> bool:
    return text.rstrip(WHITE)[-1:] not in (".", "!", "?")


def lattice(roles: Sequence[str], texts: Sequence[str], repeated: Sequence[bool]) -> tuple[Lattice, list[int]]:
    """The lattice of rows in order, and how many are blank, duplicate and truncated, each by its first fault."""
    blank = [is_blank(t) for t in texts]
    doomed = [b or bool(r) for b, r in zip(blank, repeated)]
    truncated = [not d and is_truncated(t) for d, t in zip(doomed, texts)]
    return Lattice([r[:1] for r in roles], truncated, doomed), [sum(blank), sum(doomed) - sum(blank), sum(truncated)]


def seen_before(roles: Sequence[str], texts: Sequence[str]) -> list[bool]:
    seen: set[tuple[str, str]] = set()
    return [(r, t) in seen or bool(seen.add((r, t))) for r, t in zip(roles, texts)]


def illegal_pairs(initials: Sequence[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows ``conv_id, turn, role, text`` with ``n`` copies after damage: 0 where dropped, 2 where repeated.

    Nulls of role and text become one space, as they do, with those of the
    ids, in what is hashed.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    return rows.select("conv_id", "turn", "role", "text").select(
        "conv_id",
        "turn",
        F.when(h == 4, F.lit("user")).otherwise(space("role")).alias("role"),
        F.when(h == 1, F.lit("")).when(h == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text")).alias("text"),
        F.when(h == 0, 0).when(h == 3, 2).otherwise(1).alias("n"),
    )


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``conv_id`` and what its repair found, of rows ``conv_id, turn, role, text, n``, each standing for ``n`` rows.

    Rows go by turn, nulls first, then by role and text; equal rows are side by
    side.  ``gaps`` are missing turns; ``blank``, ``duplicate`` and
    ``truncated`` count rows by their first fault, ``illegal`` neighbours that
    no conversation has; ``cost`` and ``audit`` are those of the cheapest
    edits, and ``repaired_sha256`` is that of the repaired lines.  A null
    ``conv_id`` is a conversation of its own; one without rows has zeros, an
    empty audit and the digest of nothing; an empty table gives no rows; other
    columns are ignored.  Role and text are never null here: :func:`damaged`
    has replaced them.

    Conversations of up to ``block`` rows are solved each in a task.  A longer
    one is dealt over tasks by its order into blocks, each of which is searched
    from every state to every other; the blocks' costs then make a lattice of
    their own.  Its texts never meet in one row; its audit, which is a result,
    does.
    """
    rows = rows.select("conv_id", "turn", "role", "text", "n")
    long = rows.groupBy("conv_id").agg(F.sum("n").alias("rows")).where(F.col("rows") > block).select(F.col("conv_id").alias("long_id"))
    many = long.count()
    if not many:
        return _short(rows)
    same = F.col("conv_id").eqNullSafe(F.col("long_id"))
    side = F.broadcast(long) if many <= FEW else long
    return _short(rows.join(side, same, "left_anti")).unionByName(_long(rows.join(side, same, "left_semi"), block))


def conversations(rows: DataFrame) -> DataFrame:
    """:func:`repair` of conversations after damage."""
    return repair(damaged(rows))


def repaired(rows: DataFrame) -> DataFrame:
    """``conv_id, audit, lines`` of conversations of up to ``BLOCK`` rows: the repaired ``role:text`` lines; longer ones fail the job.

    Rows, nulls and ties are as in :func:`repair`.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = []
            for roles, texts in zip(part["roles"], part["texts"]):
                if len(roles) > BLOCK:
                    raise ValueError("a conversation too long for one row")
                grid, _ = lattice(roles, texts, seen_before(roles, texts))
                audit = grid.cheapest(START, (START, ASSISTANT))[1]
                found.append((audit, apply(audit, START, roles, texts)[0]))
            yield pd.DataFrame({"conv_id": part["conv_id"], "audit": [x[0] for x in found], "lines": [x[1] for x in found]})

    kind = rows.schema["conv_id"].dataType.simpleString()
    return _gathered(rows).mapInPandas(run, f"conv_id {kind}, audit string, lines array<string>")


def _gathered(rows: DataFrame) -> DataFrame:
    """A row per conversation with its rows' columns as arrays, in order."""
    own = F.array_repeat(F.struct(F.col("turn").cast("long").alias("turn"), "role", "text"), F.col("n").cast("int"))
    all_rows = F.sort_array(F.flatten(F.collect_list(own)))
    turns = F.filter("rows.turn", lambda t: t.isNotNull())
    gaps = F.coalesce(F.array_max(turns) - F.array_min(turns) + 1 - F.size(F.array_distinct(turns)), F.lit(0))
    return rows.groupBy("conv_id").agg(all_rows.alias("rows")).select("conv_id", gaps.alias("gaps"), F.col("rows.role").alias("roles"), F.col("rows.text").alias("texts"))


def _short(rows: DataFrame) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = []
            for roles, texts in zip(part["roles"], part["texts"]):
                grid, faults = lattice(roles, texts, seen_before(roles, texts))
                cost, audit = grid.cheapest(START, (START, ASSISTANT))
                lines = apply(audit, START, roles, texts)[0]
                found.append((*faults, illegal_pairs(grid.initials), cost, audit, _sha(lines)))
            yield pd.concat([part[["conv_id", "gaps"]].reset_index(drop=True), pd.DataFrame(found, columns=[c.split()[0] for c in _RESULT.split(", ")[1:]])], axis=1)

    return _gathered(rows).mapInPandas(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {_RESULT}")


def _sha(lines: list[str]) -> str:
    return hashlib.sha256("\n".join(lines).encode("utf-8", "replace")).hexdigest()


def _numbered(rows: DataFrame) -> DataFrame:
    """One row for each of the ``n`` copies, with ``repeated``: equal role and text came before in its conversation.

    Equal rows are counted before anything is dealt, and texts are compared by
    digests.
    """
    equal = rows.where("n > 0").groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n")).withColumn("digest", F.sha2("text", 256))
    # Nulls are below every turn.
    rank = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = equal.groupBy("conv_id", "role", "digest").agg(F.min(rank).alias("first")).select(*[F.col(c).alias(f"f_{c}") for c in ("conv_id", "role", "digest")], "first")
    same = F.col("conv_id").eqNullSafe(F.col("f_conv_id")) & (F.col("role") == F.col("f_role")) & (F.col("digest") == F.col("f_digest"))
    marked = equal.join(first, same).withColumn("later", ~F.col("first.turn").eqNullSafe(F.col("turn")))
    thousands = marked.withColumn("from", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(1_000))))
    copies = thousands.withColumn("copy", F.explode(F.sequence(F.col("from") + 1, F.least(F.col("from") + 1_000, F.col("n")))))
    repeated = F.col("later") | (F.col("copy") > 1)
    return copies.select("conv_id", "turn", "role", "text", "copy", repeated.alias("repeated"))


def _long(rows: DataFrame, block: int) -> DataFrame:
    """As :func:`_short`, by blocks."""
    spark = rows.sparkSession
    kind = rows.schema["conv_id"].dataType.simpleString()
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text", "copy")]
    dealt = _numbered(rows).select("conv_id", "turn", "role", "text", "copy", "repeated").repartitionByRange(*order).sortWithinPartitions(*order)

    def blocks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row per block: consecutive rows of one conversation within a partition."""
        task, number = TaskContext.get().partitionId(), 0
        held: list[pd.DataFrame] = []

        def flush() -> pd.DataFrame:
            nonlocal held, number
            own = pd.concat(held)
            held, number = [], number + 1
            roles, texts = own["role"].tolist(), own["text"].tolist()
            grid, faults = lattice(roles, texts, own["repeated"].tolist())
            ways = [(p, q, *found) for p in STATES for q in STATES if (found := grid.cheapest(p, (q,)))]
            return pd.DataFrame({
                "conv_id": own["conv_id"].iloc[:1], "part": task, "block": number - 1,
                "blank": faults[0], "duplicate": faults[1], "truncated": faults[2], "illegal": illegal_pairs(grid.initials), "first": roles[0][:1], "last": roles[-1][:1],
                "enter": [[w[0] for w in ways]], "leave": [[w[1] for w in ways]], "costs": [[w[2] for w in ways]], "audits": [[w[3] for w in ways]],
                "roles": [roles], "texts": [["" if d else t for d, t in zip(grid.doomed, texts)]],
            })

        for part in parts:
            at = 0
            keys = part["conv_id"].astype(object).where(part["conv_id"].notna(), None).tolist()
            while at < len(part):
                if held and (len(own := held[0]) and _key(own["conv_id"].iloc[0]) != keys[at] or sum(map(len, held)) >= block):
                    yield flush()
                room = block - sum(map(len, held))
                to = at
                while to < min(len(part), at + room) and keys[to] == keys[at]:
                    to += 1
                held.append(part.iloc[at:to])
                at = to
        if held:
            yield flush()

    schema = (
        f"conv_id {kind}, part int, block int, blank long, duplicate long, truncated long, illegal long, first string, last string, "
        "enter array<int>, leave array<int>, costs array<long>, audits array<string>, roles array<string>, texts array<string>"
    )
    dealt.mapInPandas(blocks, schema).write.parquet(path := scratch(spark, "blocks"))
    stored = spark.read.parquet(path)

    def chain(own: pd.DataFrame) -> pd.DataFrame:
        """The best way through a conversation's blocks: a row for each, with its part of the audit, and the sums on the first."""
        own = own.sort_values(["part", "block"])
        labels: dict[int, tuple[int, str, tuple]] = {START: (0, "", ())}
        for row in own.itertuples():
            after: dict[int, tuple[int, str, tuple]] = {}
            for p, q, cost, audit in zip(row.enter, row.leave, row.costs, row.audits):
                if p in labels:
                    c, before, way = labels[p]
                    found = (c + cost, before + audit, (way, p, audit))
                    if q not in after or found[:2] < after[q][:2]:
                        after[q] = found
            labels = after
        cost, audit, way = min((labels[q] for q in (START, ASSISTANT) if q in labels), key=lambda x: x[:2])
        steps = []
        while way:
            way, p, part = way
            steps.append((p, part))
        steps.reverse()
        across = sum(a + b not in ("su", "ua", "au") for a, b in zip(own["last"], own["first"].iloc[1:]))
        head = [True] + [False] * (len(own) - 1)
        return pd.DataFrame({
            "conv_id": own["conv_id"], "part": own["part"], "block": own["block"], "state": [p for p, _ in steps], "own_audit": [a for _, a in steps], "head": head,
            **{c: int(own[c].sum()) for c in ("blank", "duplicate", "truncated")}, "illegal": int(own["illegal"].sum()) + across,
            "cost": cost, "audit": [audit if h else None for h in head],
        })

    sums = "blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    chained = stored.drop("roles", "texts").groupBy("conv_id").applyInPandas(chain, f"conv_id {kind}, part int, block int, state int, own_audit string, head boolean, {sums}")
    chained.write.parquet(chosen := scratch(spark, "chosen"))
    ways = spark.read.parquet(chosen)

    def lines(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            data = ["\n".join(apply(a, s, r, t)[0]) for a, s, r, t in zip(part["own_audit"], part["state"], part["roles"], part["texts"])]
            full = ["I" in a or "K" in a or "R" in a for a in part["own_audit"]]
            yield pd.DataFrame({"conv_id": part["conv_id"], "part": part["part"], "block": part["block"], "full": full, "lines": data})

    def hashes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Digests of conversations whose blocks' lines come in order; no more than a batch is held."""
        key, sha, began = None, None, False
        for part in parts:
            done = []
            for conv, full, text in zip(part["conv_id"], part["full"], part["lines"]):
                conv = _key(conv)
                if sha is None or conv != key:
                    if sha is not None:
                        done.append((key, sha.hexdigest()))
                    key, sha, began = conv, hashlib.sha256(), False
                if full:
                    sha.update((("\n" if began else "") + text).encode("utf-8", "replace"))
                    began = True
            yield _pairs(done)
        if sha is not None:
            yield _pairs([(key, sha.hexdigest())])

    # A partition of the range holds whole blocks only, so part and block name one.
    texts = stored.select("part", "block", "conv_id", "roles", "texts").join(ways.select("part", "block", "state", "own_audit"), ["part", "block"])
    parts = texts.mapInPandas(lines, f"conv_id {kind}, part int, block int, full boolean, lines string")
    by_key = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")
    hashed = by_key.mapInPandas(hashes, f"hash_id {kind}, repaired_sha256 string")
    names = [c.split()[0] for c in sums.split(", ")]
    turn = F.when(F.col("n") > 0, F.col("turn"))
    gaps = rows.groupBy(F.col("conv_id").alias("gap_id")).agg(F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn), F.lit(0)).alias("gaps"))
    key = F.col("conv_id")
    found = ways.where("head").join(hashed, key.eqNullSafe(F.col("hash_id"))).join(gaps, key.eqNullSafe(F.col("gap_id")))
    return found.select("conv_id", "gaps", *names, "repaired_sha256")


def _key(x):
    return None if pd.isna(x) else x


def _pairs(done: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame({"hash_id": pd.Series([k for k, _ in done], dtype=object), "repaired_sha256": pd.Series([h for _, h in done], dtype=object)})
