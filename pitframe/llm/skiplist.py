"""Fill-in-middle: cuts at unit ranks, found in an indexable skip list over a text's units."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitframe.llm.chunks import slices

#: Nodes of a lane that one node of the lane above spans, and characters measured at a time.
SPAN = 16
STRETCH = 1 << 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def unit_lengths(text: str) -> Iterator[np.ndarray]:
    """Code points of each unit, stretch by stretch: a run of A-Z and a-z, or any other single character."""
    held = 0  # letters of a run that the stretch before ended in
    for lo in range(0, len(text), STRETCH):
        points = np.frombuffer(text[lo : lo + STRETCH].encode("utf-32-le", "surrogatepass"), np.uint32)
        folded = points | 32
        letter = (folded >= 97) & (folded <= 122)
        first = np.append(not (held and letter[0]), ~(letter[1:] & letter[:-1]))
        starts = np.flatnonzero(first)
        if not len(starts):  # the run goes on through all of it
            held += len(points)
            continue
        ends = np.append(starts[1:], len(points))
        lengths = (ends - starts).astype(np.uint32)
        if held:
            yield np.array([held + starts[0]], np.uint32)
        held = int(lengths[-1]) if letter[-1] else 0
        yield lengths[:-1] if held else lengths
    if held:
        yield np.array([held], np.uint32)


class SkipList:
    """Lanes of nodes with two widths: the units and the code points from a node to the next one of its lane.

    The lowest lane has a node for each unit; every ``SPAN``-th node of a lane
    stands in the lane above, too.  Heights follow from ranks, so equal texts
    have equal lists.
    """

    def __init__(self, lengths: np.ndarray) -> None:
        self.n = len(lengths)
        self.lanes: list[tuple[np.ndarray, np.ndarray]] = [(np.ones(self.n, np.int64), lengths)]
        while len(self.lanes[-1][0]) > SPAN:
            units, points = self.lanes[-1]
            at = np.arange(0, len(units), SPAN)
            self.lanes.append((np.add.reduceat(units, at), np.add.reduceat(points.astype(np.int64), at)))

    def offset(self, rank: int) -> int:
        """Code points before the unit of ``rank``: from the top lane down, a step is taken while it does not pass the rank."""
        if not 0 <= rank <= self.n:
            raise IndexError(rank)
        node, left, offset = 0, rank, 0
        for units, points in reversed(self.lanes):
            while node < len(units) and units[node] <= left:
                left -= int(units[node])
                offset += int(points[node])
                node += 1
            node *= SPAN
        return offset


def draws(doc_id: int | None) -> list[int]:
    """The four numbers that a document's cuts and form depend on; a null id has those of no digits."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def transform(doc_id: int | None, text: str) -> tuple[int, str, int | None, int | None, str]:
    """``n, form, prefix_chars, middle_chars, output`` of a text."""
    h1, h2, h3, h4 = draws(doc_id)
    units = SkipList(np.concatenate([np.empty(0, np.uint32), *unit_lengths(text)]))
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= 90:
        return units.n, "plain", None, None, text
    a, b = (units.offset(rank) for rank in sorted((h1 % (units.n + 1), h2 % (units.n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return units.n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return units.n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text that an output of ``form`` was made from."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    if form not in ("psm", "spm") or not output.startswith(first):
        raise ValueError("no output of this form")
    head, mark, rest = output[len(first) :].partition(second)
    tail, end, middle = rest.partition(MIDDLE)
    if not (mark and end):
        raise ValueError("no output of this form")
    prefix, suffix = (head, tail) if form == "psm" else (tail, head)
    return prefix + middle + suffix


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every text.

    ``n`` counts the units.  A null text is an empty one; an empty one, one
    that holds a mark, and a tenth of the others stay plain, with null counts.
    A row for each row, repeated or with a null ``doc_id`` alike (the latter
    draw as if its digits were none); an empty table gives none; other columns
    are ignored.  Whole texts are cut, measured in stretches of bounded size;
    cuts at equal ranks give an empty middle.
    """
    return _mapped(docs, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string", lambda own: _frame(own).assign(output=[x[4] for x in own["done"]]))


def restore_documents(done: DataFrame) -> DataFrame:
    """``doc_id, text`` of rows ``doc_id, form, output``; a null form or output gives a null text, an output not of its form fails the job."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "text": [None if x is None or f is None else restore(x, f) for x, f in zip(part["output"], part["form"])]})

    return done.select(F.col("doc_id").cast("long").alias("doc_id"), "form", "output").mapInPandas(run, "doc_id long, text string")


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256`` of every text.

    Rows are as in :func:`fill_in_middle`; the text is rebuilt from output and
    form alone, in the same pass, so outputs stay within their task.
    """

    def finish(own: pd.DataFrame) -> pd.DataFrame:
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "replace")).hexdigest()
        return _frame(own).assign(output_sha256=[sha(x[4]) for x in own["done"]], restored_sha256=[sha(restore(x[4], x[1])) for x in own["done"]])

    return _mapped(docs, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string", finish)


def _frame(own: pd.DataFrame) -> pd.DataFrame:
    done = own["done"]
    counts = {c: pd.array([x[i] for x in done], "Int64") for i, c in ((2, "prefix_chars"), (3, "middle_chars"))}
    return pd.DataFrame({"doc_id": pd.array(own["doc_id"], "Int64"), "n": [x[0] for x in done], "form": [x[1] for x in done], **counts})


def _mapped(docs: DataFrame, schema: str, finish) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for own in slices(part):
                ids = [None if pd.isna(i) else int(i) for i in own["doc_id"]]
                yield finish(pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "done": [transform(i, t) for i, t in zip(ids, own["text"])]}))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(run, schema)
