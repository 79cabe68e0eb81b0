"""Media columns: byte payloads in MPEG transport streams (ISO/IEC 13818-1)."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKET = 188
FRAME = 192
#: Bytes of an access unit, and units from one random-access point to the next.
UNIT = 10 * FRAME
RANDOM_ACCESS = 4
FIRST_PTS = 90_000
TICKS = 3_600
PROGRAM, PMT_PID, STREAM_PID = 1, 0x1000, 0x100
STREAM_TYPE = 0x06  # private data in PES packets
_LENGTH_TAG = 0x80  # user-private descriptor: the payload's length without padding


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        table.append(c)
    return table


_CRC = _crc_table()


def crc_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8) & 0xFFFFFFFF ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\0\0"
    return head + body + crc_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (b"\x47" + (0x4000 | pid).to_bytes(2, "big") + b"\x10\0" + section).ljust(PACKET, b"\xff")


_PAT = _table_packet(0, _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))


def _pmt(n_bytes: int) -> bytes:
    note = bytes([_LENGTH_TAG, 8]) + n_bytes.to_bytes(8, "big")
    stream = bytes([STREAM_TYPE]) + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\0"
    return _table_packet(PMT_PID, _section(2, PROGRAM, (0xE000 | STREAM_PID).to_bytes(2, "big") + (0xF000 | len(note)).to_bytes(2, "big") + note + stream))


def _counted(packet: bytes, counter: int) -> bytes:
    """A table packet with its continuity counter."""
    return packet[:3] + bytes([0x10 | counter & 15]) + packet[4:]


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29) & 0x0E, (pts >> 22) & 0xFF, 0x01 | (pts >> 14) & 0xFE, (pts >> 7) & 0xFF, 0x01 | (pts << 1) & 0xFE])


def _unit_packets(unit: bytes, pts: int, random_access: bool, counter: int) -> np.ndarray:
    """The transport packets of one access unit, in one PES packet."""
    pes = b"\0\0\x01\xbd" + (len(unit) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + _stamp(pts) + unit
    clock = pts.to_bytes(8, "big")  # 33 bits of base, 6 reserved, 9 of extension
    base = int.from_bytes(clock, "big") << 15 | 0x7E00
    field = bytes([0x50 if random_access else 0x10]) + base.to_bytes(6, "big")
    first = PACKET - 5 - len(field)
    k = 1 + max(0, -(-(len(pes) - first) // 184))
    out = np.full((k, PACKET), 0xFF, np.uint8)
    out[:, 0] = 0x47
    out[:, 1], out[:, 2] = STREAM_PID >> 8, STREAM_PID & 0xFF
    out[0, 1] |= 0x40
    out[:, 3] = 0x10 | (counter + np.arange(k)) & 15
    data = np.frombuffer(pes, np.uint8)
    head = min(first, len(data))
    out[0, 3] |= 0x20
    out[0, 4] = PACKET - 5 - head
    out[0, 5 : 5 + len(field)] = np.frombuffer(field, np.uint8)
    out[0, PACKET - head :] = data[:head]
    if k > 1:
        full = k - 2
        out[1 : 1 + full, 4:] = data[head : head + 184 * full].reshape(full, 184)
        rest = data[head + 184 * full :]
        if pad := 184 - len(rest):
            out[-1, 3] |= 0x20
            out[-1, 4] = pad - 1
            if pad > 1:
                out[-1, 5] = 0
        out[-1, PACKET - len(rest) :] = rest
    return out


def mux(payload: bytes, n_bytes: int) -> bytes:
    """A transport stream of one program whose only stream carries ``payload``.

    The program tables come before each random-access point, so that a reader
    who starts there finds them.
    """
    parts, counter, pmt = [], 0, _pmt(n_bytes)
    for i, at in enumerate(range(0, len(payload), UNIT)):
        if i % RANDOM_ACCESS == 0:
            parts += [_counted(_PAT, i // RANDOM_ACCESS), _counted(pmt, i // RANDOM_ACCESS)]
        packets = _unit_packets(payload[at : at + UNIT], FIRST_PTS + i * TICKS, i % RANDOM_ACCESS == 0, counter)
        counter += len(packets)
        parts.append(packets.tobytes())
    return b"".join(parts)


def _read_section(packets: np.ndarray, pid: int) -> bytes:
    """The section that starts in the first packet of ``pid``; raises where its checksum fails."""
    own = np.flatnonzero(((packets[:, 1].astype(int) & 0x1F) << 8 | packets[:, 2]) == pid)
    if not len(own):
        raise ValueError(f"no packet of PID {pid}")
    data = packets[own[0]].tobytes()
    at = 4 + (1 + data[4] if data[3] & 0x20 else 0)
    at += 1 + data[at]
    size = 3 + (int.from_bytes(data[at + 1 : at + 3], "big") & 0xFFF)
    section = data[at : at + size]
    if len(section) < size or crc_mpeg(section):
        raise ValueError(f"damaged section on PID {pid}")
    return section


def _continuity(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which packets of one PID break its count, and which are the one repetition that a packet may have.

    A packet with a payload counts one on; one without keeps the count; one
    whose adaptation field says so may have any count.  A repetition has the
    count and the bytes of the packet before, its clock apart.
    """
    control, counter = p[:, 3] >> 4 & 3, p[:, 3].astype(np.int32) & 15
    has, field = control & 1 != 0, control & 2 != 0
    flags = np.where(field & (p[:, 4] > 0), p[:, 5], 0)
    step = np.append(1, np.diff(counter) % 16)
    alike = p[1:] == p[:-1]
    alike[:, 6:12] |= (flags[1:] & flags[:-1] & 0x10 != 0)[:, None]  # the clock
    again = np.append(False, has[1:] & has[:-1] & (step[1:] == 0) & alike.all(1)) if len(p) else np.zeros(0, bool)
    again[1:] &= ~again[:-1]
    wrong = (flags & 0x80 == 0) & ~again & (step != has)
    wrong[:1] = False
    return wrong, again


def demux(media: bytes) -> dict:
    """The payload and structure of a transport stream, or a ``ValueError`` that says what is wrong.

    Follows the program association and map tables to the first elementary
    stream, checks its continuity counters (repeated packets, packets without
    payload and flagged jumps are as they should be), joins its PES packets,
    and lists each unit's timestamp, first packet and whether decoding may start there.
    """
    if not media or len(media) % PACKET:
        raise ValueError("not a whole number of transport packets")
    packets = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != 0x47).any():
        raise ValueError("lost packet alignment")
    pat = _read_section(packets, 0)
    pmt_pid = int.from_bytes(pat[10:12], "big") & 0x1FFF
    pmt = _read_section(packets, pmt_pid)
    info = int.from_bytes(pmt[10:12], "big") & 0xFFF
    note = pmt[12 : 12 + info]
    n_bytes = int.from_bytes(note[2:10], "big") if note[:1] == bytes([_LENGTH_TAG]) else None
    stream_type = pmt[12 + info]
    pid = int.from_bytes(pmt[13 + info : 15 + info], "big") & 0x1FFF
    own = np.flatnonzero(((packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]) == pid)
    wrong, again = _continuity(packets[own])
    if gaps := int(wrong.sum()):
        raise ValueError(f"{gaps} continuity errors")
    own = own[~again]
    p = packets[own]
    control = p[:, 3] >> 4 & 3
    extra = np.where(control & 2, p[:, 4].astype(np.int32) + 1, 0)
    offset = np.where(control & 1, 4 + extra, PACKET)
    starts = np.flatnonzero(p[:, 1] & 0x40)
    sizes = PACKET - offset
    data = p[np.arange(PACKET)[None, :] >= offset[:, None]]
    at = (np.cumsum(sizes) - sizes)[starts]
    if len(at) == 0 or (data[at] | data[at + 1]).any() or (data[at + 2] != 1).any():
        raise ValueError("a PES packet does not start where it should")
    b = data[at[:, None] + np.arange(9, 14)[None, :]].astype(np.int64)
    pts = (b[:, 0] >> 1 & 7) << 30 | b[:, 1] << 22 | (b[:, 2] >> 1) << 15 | b[:, 3] << 7 | b[:, 4] >> 1
    length = data[at + 4].astype(np.int64) << 8 | data[at + 5]
    if (np.diff(np.append(at, len(data))) != length + 6).any():
        raise ValueError("a PES packet has not the length it states")
    header = 9 + data[at + 8].astype(np.int64)
    keep = np.ones(len(data), bool)
    for i in range(int(header.max())):
        keep[at[i < header] + i] = False
    rap = (p[starts, 3] & 0x20 != 0) & (p[starts, 4] > 0) & (p[starts, 5] & 0x40 != 0)
    return {
        "payload": data[keep].tobytes(), "n_bytes": n_bytes, "pmt_pid": pmt_pid, "pid": pid, "stream_type": stream_type,
        "continuity_errors": gaps, "pts": pts.tolist(), "packet": own[starts].tolist(), "random_access": rap.tolist(),
    }


def padded(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode("utf-8", "replace")
    return data.ljust(max(FRAME, -(-len(data) // FRAME) * FRAME), b" "), len(data)


def store(docs: DataFrame) -> DataFrame:
    """``doc_id, media``: every text as a transport stream; a null text is an empty one, of one padded frame.

    A row for each row, repeated or with a null id, the whole text however
    long; other columns are ignored.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for lo in range(0, len(part), 1000):
                own = part.iloc[lo : lo + 1000]
                yield pd.DataFrame({"doc_id": own["doc_id"], "media": [mux(*padded(t)) for t in own["text"]]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, media binary")


def probe(media: DataFrame) -> DataFrame:
    """What each stream of ``doc_id, media`` holds, from its stored bytes alone.

    Returns ``doc_id``, the payload's lengths and digests, the stream's own,
    ``feature``, ``error``, and ``timeline``: timestamp, first packet and random
    access of each unit.  A stream that is null, cut or damaged (lost packets,
    a table whose checksum fails, a unit that has not the length it states)
    has an ``error`` and nulls for what cannot be told; the others are not
    touched by it.  A row for each row, repeated or with a null id; an empty
    table gives an empty one; other columns are ignored.
    """
    schema = (
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
        "feature string, error string, pts array<long>, packet array<long>, random_access array<boolean>"
    )

    def one(doc_id, data: bytes) -> tuple:
        try:
            x = demux(data or b"")
        except (ValueError, IndexError) as e:
            size, digest = (None, None) if data is None else (len(data), hashlib.sha256(data).hexdigest())
            return (doc_id, None, None, None, None, size, digest, None, str(e) or "damaged", None, None, None)
        payload = x["payload"]
        samples = np.frombuffer(payload, np.uint8)
        feature = (
            f"packets={len(data) // PACKET};units={len(x['pts'])};random_access={sum(x['random_access'])};type={x['stream_type']};"
            f"continuity_errors={x['continuity_errors']};first_pts={x['pts'][0]};last_pts={x['pts'][-1]};sum={int(samples.sum(dtype=np.int64))};peak={int(samples.max())}"
        )
        return (
            doc_id, x["n_bytes"], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data),
            hashlib.sha256(data).hexdigest(), feature, None, x["pts"], x["packet"], x["random_access"],
        )

    names = [c.split()[0] for c in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([one(*row) for row in zip(part["doc_id"], part["media"])], columns=names, dtype=object)

    out = media.select("doc_id", "media").mapInPandas(run, schema)
    return out.withColumn("timeline", F.arrays_zip("pts", "packet", "random_access")).drop("pts", "packet", "random_access")
