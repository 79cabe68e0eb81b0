"""Token ids in files of fixed-width bit-packed blocks."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitframe.llm.chunks import MOST_CHUNKS, ChunkEncoder, slices

MAGIC = b"PKID"
#: Ids of a block, a multiple of 8, and of an image, about.
BLOCK = 4096
IMAGE_IDS = 1 << 20
#: Parts that a worker remembers, and those that it keeps when it has met that many.
REMEMBERED, KEPT = 1_200_000, 600_000
_HEAD = struct.Struct("<4sHHIQQQQ")  # magic, version, width, block, first id's place, ids, documents, blocks


def width_of(vocab: int) -> int:
    return max(1, (vocab - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> np.ndarray:
    """Ids of ``width`` bits each, least bit first; eight ids fill ``width`` bytes."""
    if width in (8, 16, 32):  # whole bytes
        padded = np.zeros(-(-len(ids) // 8) * 8, f"<u{width // 8}")
        padded[: len(ids)] = ids
        return padded.view(np.uint8)
    groups = np.zeros((-(-len(ids) // 8), 8), np.uint64)
    groups.reshape(-1)[: len(ids)] = ids
    out = np.zeros((len(groups), width), np.uint8)
    for j in range(8):
        first, shift = divmod(j * width, 8)
        v = groups[:, j] << np.uint64(shift)
        for k in range(-(-(shift + width) // 8)):
            out[:, first + k] |= (v >> np.uint64(8 * k) & np.uint64(255)).astype(np.uint8)
    return out.reshape(-1)


def unpack_bits(data: np.ndarray, width: int, n: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data[: n * width // 8].tobytes(), f"<u{width // 8}").astype(np.uint32)
    groups = data[: -(-n // 8) * width].reshape(-1, width)
    out = np.empty((len(groups), 8), np.uint32)
    for j in range(8):
        first, shift = divmod(j * width, 8)
        v = np.zeros(len(groups), np.uint64)
        for k in range(-(-(shift + width) // 8)):
            v |= groups[:, first + k].astype(np.uint64) << np.uint64(8 * k)
        out[:, j] = v >> np.uint64(shift) & np.uint64((1 << width) - 1)
    return out.reshape(-1)[:n]


def write_image(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, first: int, width: int) -> bytes:
    """A file image: header, documents' ids and ends, blocks' offsets, blocks.

    ``first`` is the place of its first id within its shard.  Each block is
    packed on its own and found by its offset, so any id is reached by
    unpacking one block.
    """
    blocks = [pack_bits(ids[i : i + BLOCK], width) for i in range(0, len(ids), BLOCK)]
    offsets = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    head = _HEAD.pack(MAGIC, 1, width, BLOCK, first, len(ids), len(doc_ids), len(blocks))
    return b"".join([head, doc_ids.astype("<i8").tobytes(), np.cumsum(counts).astype("<u8").tobytes(), offsets.tobytes(), *(b.tobytes() for b in blocks)])


class Image:
    """A reader of a file image; slices unpack only the blocks that they touch."""

    def __init__(self, data: bytes) -> None:
        magic, version, self.width, self.block, self.first, self.n, docs, blocks = _HEAD.unpack_from(data)
        if magic != MAGIC or version != 1:
            raise ValueError("not an image of packed ids")
        at = _HEAD.size
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.ends = np.frombuffer(data, "<u8", docs, at + 8 * docs).astype(np.int64)
        self.offsets = np.frombuffer(data, "<u8", blocks + 1, at + 16 * docs).astype(np.int64)
        self.data = np.frombuffer(data, np.uint8, offset=at + 16 * docs + 8 * (blocks + 1))
        if len(self.data) != self.offsets[-1]:
            raise ValueError("a cut image")

    def ids(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """The ids at places ``lo`` to ``hi`` of the image."""
        hi = self.n if hi is None else min(hi, self.n)
        if lo >= hi:
            return np.empty(0, np.uint32)
        a, b = lo // self.block, -(-hi // self.block)
        parts = [unpack_bits(self.data[self.offsets[i] : self.offsets[i + 1]], self.width, min(self.block, self.n - i * self.block)) for i in range(a, b)]
        return np.concatenate(parts)[lo - a * self.block : hi - a * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))


@lru_cache(maxsize=2)
def _encoder(path: str, most: int = MOST_CHUNKS, keep: int = 0) -> ChunkEncoder:
    """A worker's encoder: ``tokenizers`` on the parts that it does not remember; of ``most``, it keeps ``keep`` when it starts anew."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    blank = np.zeros(tok.get_vocab_size(), bool)
    blank[[i for w, i in tok.get_vocab().items() if w.startswith("Ġ")]] = True

    def alone(texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Parts that begin with a blank and hold no other go to the library joined, as a text would be."""
        counts, out = np.zeros(len(texts), np.int64), []
        full = [i for i, t in enumerate(texts) if t]
        groups = [full[i : i + 1000] for i in range(0, len(full), 1000)]
        joined = ["".join(texts[i] for i in g) for g in groups]
        led = [t.count(" ") == len(g) > 1 and all(texts[i][0] == " " and not texts[i][1:2].isspace() for i in g) for g, t in zip(groups, joined)]
        found = iter(alone([t for t, ok in zip(joined, led) if ok]))
        for group, ok in zip(groups, led):
            if ok:
                ids = next(found)
                starts = np.flatnonzero(blank[ids])
                if len(starts) == len(group):
                    counts[group] = np.diff(np.append(starts, len(ids)))
                    out.append(ids)
                    continue
            own = alone([texts[i] for i in group])  # also where some part does not begin with a token that has the blank
            counts[group] = [len(x) for x in own]
            out += own
        return counts, np.concatenate([np.empty(0, np.int32), *out])

    return ChunkEncoder(encode, most, keep)


def write_ids(docs: DataFrame, tokenizer: str, vocab: int, end_id: int, path: str) -> None:
    """Writes all documents' ids to ``path``, in ascending ``doc_id``.

    ``docs`` has ``doc_id`` and ``text`` (null: empty; other columns are
    ignored); each document ends with ``end_id``, so an empty one is that id
    alone.  An added token's string in a text is that token, as the library
    has it.  Repeated rows are written as often as they come; an empty table
    gives no images.  A text is encoded whole, however long.  Rows are dealt into ranges of ``doc_id``, the shards;
    ties go by text, null ids come first.  A shard is a run of images of
    about ``IMAGE_IDS`` ids in Parquet rows ``shard, image, n_ids, data``, so
    writing is atomic per task and works on any store that Spark reaches.
    """
    width = width_of(vocab)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, shard = _encoder(tokenizer, REMEMBERED, KEPT), TaskContext.get().partitionId()
        first, image, held = 0, 0, []

        def flush() -> pd.DataFrame:
            nonlocal first, image, held
            doc_ids, counts, ids = (np.concatenate(x) for x in zip(*held))
            data = write_image(doc_ids, counts, ids, first, width)
            row = pd.DataFrame({"shard": [shard], "image": [image], "n_ids": [len(ids)], "data": [data]})
            first, image, held = first + len(ids), image + 1, []
            return row

        for part in parts:
            for own in slices(part, chars=4_000_000):
                counts, ids = encode(own["text"].tolist())
                ends = np.cumsum(counts)
                doc_ids = own["doc_id"].astype("Int64").fillna(np.iinfo(np.int64).min).to_numpy(np.int64)
                held.append((doc_ids, counts + 1, np.insert(ids, ends, end_id)))
                if sum(len(x[2]) for x in held) >= IMAGE_IDS:
                    yield flush()
        if held:
            yield flush()

    rows.mapInPandas(run, "shard int, image int, n_ids long, data binary").write.option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, tokens`` of every document in the files at ``path``: its ids as little-endian unsigned 32-bit integers."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for data in part["data"]:
                image = Image(data)
                ids = image.ids().astype("<u4").tobytes()
                starts = np.append(0, image.ends[:-1])
                yield pd.DataFrame({"doc_id": _real_ids(image), "tokens": [ids[4 * a : 4 * b] for a, b in zip(starts, image.ends)]})

    return spark.read.parquet(path).select("data").mapInPandas(run, "doc_id long, tokens binary")


def _real_ids(image: Image) -> pd.Series:
    return pd.Series(image.doc_ids).astype("Int64").where(image.doc_ids != np.iinfo(np.int64).min)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files at ``path``.

    ``start`` counts the ids of all documents before it.  The driver gathers
    one number per shard; images tell the rest.
    """
    images = spark.read.parquet(path)
    totals = {r["shard"]: r["n"] for r in images.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}
    base, at = {}, 0
    for shard in sorted(totals):
        base[shard], at = at, at + totals[shard]
    shared = spark.sparkContext.broadcast(base)  # a number per shard

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for shard, data in zip(part["shard"], part["data"]):
                image = Image(data)
                ids = image.ids().astype("<u4").tobytes()
                starts = np.append(0, image.ends[:-1])
                yield pd.DataFrame({
                    "doc_id": _real_ids(image), "start": shared.value[shard] + image.first + starts,
                    "n_tokens": image.ends - starts, "ids_crc32": [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts, image.ends)],
                })

    return images.select("shard", "data").mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
