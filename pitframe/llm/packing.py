"""Best-fit packing of token sequences into bins of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITIES = (512, 1024, 2048, 4096)

#: What a bin costs besides its length: attention grows with the square of a
#: sequence, and every bin has a fixed part.  Short bins pay for the one, long
#: ones for the other; here full bins of 1,024 and 2,048 cost least per token,
#: so a short piece opens a bin that others are to fill.
FIXED_COST = 128.0
SQUARE_COST = 1 / 16384

#: Pieces of a shard, about; with pieces of at most the largest capacity this bounds a task's memory.
SHARD_ROWS = 4_000

_OUT = "shard int, bin int, capacity int, n_tokens int, tokens binary, doc_ids array<long>, pieces array<int>, starts array<long>, ends array<int>"


def bin_cost(capacity: int) -> float:
    return FIXED_COST + capacity + SQUARE_COST * capacity * capacity


def opening(size: int, left: int, capacities: tuple[int, ...]) -> int:
    """The permitted length with the least cost per token that it can come to hold.

    ``left`` is the number of tokens not yet packed, ``size`` among them; what
    a bin cannot fill from them counts against it.
    """
    return min((c for c in capacities if c >= size), key=lambda c: (bin_cost(c) / min(c, max(left, size)), c))


def best_fit(sizes: list[int], capacities: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """(bin, offset, capacity) of each size; sizes come in falling order.

    A size goes to the open bin that it leaves fullest, the oldest of equals;
    where none has room, a bin of the least-cost length opens.  In the end each
    bin shrinks to the least permitted length that holds its contents.
    """
    room: dict[int, list[int]] = {}
    rooms: list[int] = []
    used: list[int] = []
    open_for: list[int] = []
    placed = []
    left = sum(sizes)
    for size in sizes:
        at = bisect_left(rooms, size)
        if at < len(rooms):
            space = rooms[at]
            b = room[space].pop()
            if not room[space]:
                del room[space], rooms[at]
        else:
            b, space = len(used), opening(size, left, capacities)
            used.append(0)
            open_for.append(space)
        placed.append((b, used[b]))
        used[b] += size
        left -= size
        if rest := space - size:
            if rest not in room:
                room[rest] = []
                insort(rooms, rest)
            room[rest].append(b)
    final = [min(c for c in capacities if c >= n) for n in used]
    return [(b, offset, final[b]) for b, offset in placed]


def pack(
    docs: DataFrame,
    tokens: str = "tokens",
    width: int = 1,
    capacities: tuple[int, ...] = CAPACITIES,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """Token sequences packed into bins of the permitted lengths.

    ``docs`` has ``doc_id`` and the binary column ``tokens`` of ``width`` bytes
    a token.  A sequence longer than the largest capacity is cut into pieces
    of that capacity and a rest, so no token is lost.  Pieces are dealt by
    hash into shards of about ``shard_rows`` pieces; each shard is packed on
    its own by best fit decreasing, so a task's memory is bounded and the bins
    that a shard leaves unfilled are a few among thousands.

    Returns a row per bin: ``shard, bin`` (its name), ``capacity``,
    ``n_tokens``, ``tokens`` (its content), and the lists ``doc_ids``,
    ``pieces``, ``starts`` (a piece's place in its document) and ``ends``
    (where it ends in the bin), one entry for each piece, in order.  Rows
    whose tokens are null or empty hold nothing and are in no bin.  Repeated
    rows and null ids are packed as often as they come.  Ties in length are
    broken by ``doc_id``, piece and content.  An empty table gives no bins;
    other columns are ignored.
    """
    capacities = tuple(sorted(set(capacities)))
    top = capacities[-1]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(tokens).cast("binary").alias("tokens")).withColumn("n", F.floor(F.octet_length("tokens") / width).cast("long"))
    pieces = rows.where("n > 0").select(
        "doc_id", "tokens", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(top).cast("long"))).alias("piece", "start"), "n"
    )
    size = F.least(F.col("n") - F.col("start"), F.lit(top)).cast("int")
    own = F.substring("tokens", (F.col("start") * width + 1).cast("int"), size * width)
    total = rows.agg(F.sum(F.ceil(F.col("n") / top))).first()[0] or 0
    shards = max(1, -(-total // shard_rows))
    pieces = pieces.select("doc_id", "piece", "start", size.alias("n_tokens"), own.alias("tokens"), F.pmod(F.xxhash64("doc_id", "piece", size), F.lit(shards)).cast("int").alias("shard"))

    def one_shard(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["n_tokens", "doc_id", "piece", "tokens"], ascending=[False, True, True, True], ignore_index=True)
        placed = best_fit(part["n_tokens"].tolist(), capacities)
        held: dict[int, list[int]] = {}
        for i, (b, _, _) in enumerate(placed):
            held.setdefault(b, []).append(i)
        doc_ids, sizes = [None if pd.isna(x) else int(x) for x in part["doc_id"]], part["n_tokens"].tolist()
        return pd.DataFrame({
            "shard": int(part["shard"].iloc[0]), "bin": list(held), "capacity": [placed[at[0]][2] for at in held.values()],
            "n_tokens": [sum(sizes[i] for i in at) for at in held.values()], "tokens": [b"".join(part["tokens"].iloc[at]) for at in held.values()],
            "doc_ids": [[doc_ids[i] for i in at] for at in held.values()], "pieces": [part["piece"].iloc[at].tolist() for at in held.values()],
            "starts": [part["start"].iloc[at].tolist() for at in held.values()], "ends": [[placed[i][1] + sizes[i] for i in at] for at in held.values()],
        })

    return pieces.groupBy("shard").applyInPandas(one_shard, _OUT)


def byte_tokens(docs: DataFrame) -> DataFrame:
    """Documents with ``tokens``: a token for each byte of UTF-8, and the id 255, which no text holds, for the end.

    A null text is an empty one, so every document has a token.
    """
    return docs.withColumn("tokens", F.concat(F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")), F.lit(b"\xff")))
