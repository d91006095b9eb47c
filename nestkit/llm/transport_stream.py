"""Media columns: MPEG transport streams, written and parsed with numpy.

The parser reads the program tables, checks continuity counters, reassembles elementary packets and lists their time
stamps and random-access points. The writer stores bytes losslessly as one private stream.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table

# Fixed values of the format (ISO/IEC 13818-1).
PACKET, SYNC, NULL_PID, PAT_PID = 188, 0x47, 0x1FFF, 0x0000
PRIVATE_STREAM, PRIVATE_TYPE = 0xBD, 0x06
CLOCK = 90_000
# Choices of this writer.
PMT_PID, DATA_PID, PROGRAM = 0x1000, 0x0100, 1
UNIT = 16_384
TICKS = 3_600
#: A random-access point, with fresh program tables before it, every so many elementary packets.
ACCESS_EVERY = 12
BLOCK = 64


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        c = byte << 24
        for _ in range(8):
            c = ((c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)) & 0xFFFFFFFF
        out.append(c)
    return out


CRC = _crc_table()


@lru_cache(maxsize=64)
def section_crc(data: bytes) -> int:
    """The checksum of program tables; 0 over a section with its own checksum."""
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, key: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + key.to_bytes(2, "big") + bytes([0xC1, 0, 0])
    return head + body + section_crc(head + body).to_bytes(4, "big")


PAT = _section(0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
PMT = _section(0x02, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")


def _table_packet(pid: int, section: bytes, counter: int) -> np.ndarray:
    out = np.full(PACKET, 0xFF, np.uint8)
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10 | counter & 15, 0]) + section
    out[: len(head)] = np.frombuffer(head, np.uint8)
    return out


def _pts_bytes(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29) & 0x0E, (pts >> 22) & 0xFF, 0x01 | (pts >> 14) & 0xFE, (pts >> 7) & 0xFF, 0x01 | (pts << 1) & 0xFE])


def mux(payload: bytes) -> bytes:
    """The payload as a transport stream with one program of one private stream."""
    parts, counter = [], 0
    for k, at in enumerate(range(0, max(1, len(payload)), UNIT)):
        data, pts, access = payload[at : at + UNIT], k * TICKS, k % ACCESS_EVERY == 0
        if access:
            tables = k // ACCESS_EVERY
            parts += [_table_packet(PAT_PID, PAT, tables)[None], _table_packet(PMT_PID, PMT, tables)[None]]
        body = bytes([0, 0, 1, PRIVATE_STREAM]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _pts_bytes(pts) + data
        # The first packet carries the clock reference, and stuffing if it is also the last.
        first = min(len(body), PACKET - 12)
        rest = len(body) - first
        n = 1 + -(-rest // (PACKET - 4))
        out = np.full((n, PACKET), 0xFF, np.uint8)
        out[:, 0], out[:, 1], out[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 0xFF
        out[:, 3] = 0x10 | (counter + np.arange(n)) & 15
        counter += n
        out[0, 1] |= 0x40
        out[0, 3] |= 0x20
        pcr = (pts << 15) | 0x7E00  # 33 bits of base, 6 reserved, 9 of extension
        out[0, 4:12] = np.frombuffer(bytes([PACKET - 5 - first, 0x50 if access else 0x10]) + pcr.to_bytes(6, "big"), np.uint8)
        flat = np.frombuffer(body, np.uint8)
        out[0, PACKET - first :] = flat[:first]
        if rest:
            full, last = divmod(rest, PACKET - 4)
            out[1 : 1 + full, 4:] = flat[first : first + full * (PACKET - 4)].reshape(full, PACKET - 4)
            if last:
                out[-1, 3] |= 0x20
                out[-1, 4] = PACKET - 5 - last
                if PACKET - 5 - last:
                    out[-1, 5] = 0
                out[-1, PACKET - last :] = flat[-last:]
        parts.append(out)
    return np.concatenate(parts).tobytes()


@dataclass
class Elementary:
    """One elementary stream: its packets' data and time stamps (ticks of 90 kHz, -1 if there is none)."""

    pid: int
    kind: int
    data: list[bytes] = field(default_factory=list)
    pts: list[int] = field(default_factory=list)
    access: list[int] = field(default_factory=list)  # numbers of the packets that are random-access points
    damaged: list[int] = field(default_factory=list)  # numbers of the packets that are short or miss a part
    counter_errors: int = 0
    duplicates: int = 0


@dataclass
class Stream:
    packets: int = 0
    bad_packets: int = 0  # without the sync byte, or marked as faulty
    bad_tables: int = 0
    programs: dict[int, int] = field(default_factory=dict)  # program to PID of its map
    streams: dict[int, Elementary] = field(default_factory=dict)


def _sections(data: np.ndarray, starts: np.ndarray, at: np.ndarray, out: Stream) -> Iterator[bytes]:
    """Checked sections of one table's packets."""
    raw = data.tobytes()
    cuts = [*at[starts].tolist(), len(raw)]
    for a, b in zip(cuts, cuts[1:]):
        pos = a + 1 + (raw[a] if a < b else 0)
        while pos + 3 <= b and raw[pos] != 0xFF:
            size = 3 + (int.from_bytes(raw[pos + 1 : pos + 3], "big") & 0xFFF)
            section = raw[pos : pos + size]
            if pos + size > b or section_crc(section):
                out.bad_tables += 1
                break
            yield section
            pos += size


def parse(media: bytes) -> Stream:
    """Parses whole packets of 188 bytes; a part at the end counts as a bad packet. Never fails on damaged input."""
    out = Stream()
    whole = len(media) // PACKET
    raw = np.frombuffer(media, np.uint8, whole * PACKET).reshape(whole, PACKET)
    good = (raw[:, 0] == SYNC) & (raw[:, 1] & 0x80 == 0)
    out.packets, out.bad_packets = whole, int(whole - good.sum()) + (len(media) % PACKET > 0)
    raw = raw[good]
    pids = (raw[:, 1].astype(np.int32) & 0x1F) << 8 | raw[:, 2]
    with_field, with_data = raw[:, 3] & 0x20 > 0, raw[:, 3] & 0x10 > 0
    start = np.where(with_field, 5 + raw[:, 4].astype(np.int32), 4)
    start = np.where(with_data & (start <= PACKET), start, PACKET)

    def pieces(pid: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the PID, which of them start a unit, their data, and where each row's data begins."""
        rows = np.nonzero((pids == pid) & with_data)[0]
        own = raw[rows]
        data = own[np.arange(PACKET)[None, :] >= start[rows, None]]
        return rows, np.nonzero(own[:, 1] & 0x40)[0], data, np.concatenate(([0], np.cumsum(PACKET - start[rows])))

    _, starts, data, at = pieces(PAT_PID)
    for s in _sections(data, starts, at, out):
        if s[0] == 0:
            for i in range(8, len(s) - 4, 4):
                number, pid = int.from_bytes(s[i : i + 2], "big"), int.from_bytes(s[i + 2 : i + 4], "big") & NULL_PID
                if number:
                    out.programs[number] = pid
    for pid in sorted(set(out.programs.values())):
        _, starts, data, at = pieces(pid)
        for s in _sections(data, starts, at, out):
            if s[0] == 2:
                i = 12 + (int.from_bytes(s[10:12], "big") & 0xFFF)
                while i + 5 <= len(s) - 4:
                    es = int.from_bytes(s[i + 1 : i + 3], "big") & NULL_PID
                    out.streams.setdefault(es, Elementary(es, s[i]))
                    i += 5 + (int.from_bytes(s[i + 3 : i + 5], "big") & 0xFFF)
    for es in out.streams.values():
        _elementary(es, raw, with_field, *pieces(es.pid))
    return out


def _elementary(es: Elementary, raw: np.ndarray, with_field: np.ndarray, rows: np.ndarray, starts: np.ndarray, data: np.ndarray, at: np.ndarray) -> None:
    if not len(rows):
        return
    counter = raw[rows, 3] & 15
    step = np.diff(counter.astype(np.int16)) & 15
    announced = with_field[rows] & (raw[rows, 4] > 0) & (raw[rows, 5] & 0x80 > 0)
    again = np.zeros(len(rows), bool)
    again[1:] = (step == 0) & (raw[rows[1:]] == raw[rows[:-1]]).all(1)
    gap = np.zeros(len(rows), bool)
    gap[1:] = (step != 1) & ~again[1:] & ~announced[1:]
    es.duplicates, es.counter_errors = int(again.sum()), int(gap.sum())
    if es.duplicates:  # a packet may be sent twice; the second is dropped
        keep = ~again
        sizes = np.diff(at)
        data = data[np.repeat(keep, sizes)]
        rows, gap = rows[keep], gap[keep]
        at = np.concatenate(([0], np.cumsum(sizes[keep])))
        starts = np.nonzero(raw[rows, 1] & 0x40)[0]
    flagged = with_field[rows] & (raw[rows, 4] > 0) & (raw[rows, 5] & 0x40 > 0)
    bytes_ = data.tobytes()
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)]):
        unit = bytes_[at[a] : at[b]]
        if len(unit) < 9 or unit[:3] != b"\0\0\1":
            es.counter_errors += 1
            continue
        size, head = int.from_bytes(unit[4:6], "big"), 9 + unit[8]
        body = unit[head : 6 + size] if size else unit[head:]
        k = len(es.data)
        pts = -1
        if unit[7] & 0x80 and len(unit) >= 14:
            p = unit[9:14]
            pts = (p[0] & 0x0E) << 29 | p[1] << 22 | (p[2] & 0xFE) << 14 | p[3] << 7 | p[4] >> 1
        es.data.append(body)
        es.pts.append(pts)
        if flagged[a]:
            es.access.append(k)
        if gap[a + 1 : b].any() or size and len(unit) < 6 + size:
            es.damaged.append(k)


def feature(stream: Stream) -> str:
    """What the parser found, and the entropy of the data in bits a byte."""
    es = [stream.streams[k] for k in sorted(stream.streams)]
    data = np.frombuffer(b"".join(d for e in es for d in e.data), np.uint8)
    share = np.bincount(data, minlength=256) / max(1, len(data))
    bits = -float((share[share > 0] * np.log2(share[share > 0])).sum()) + 0.0
    pts = [p for e in es for p in e.pts if p >= 0]
    found = {
        "packets": stream.packets, "bad": stream.bad_packets + stream.bad_tables, "programs": len(stream.programs), "streams": len(es),
        "units": sum(len(e.data) for e in es), "gaps": sum(e.counter_errors for e in es), "access": sum(len(e.access) for e in es),
        "first_pts": min(pts, default=-1), "last_pts": max(pts, default=-1), "entropy": f"{bits:.4f}",
    }
    return ";".join(f"{k}={v}" for k, v in found.items())


def padded(data: bytes) -> bytes:
    return data + bytes(BLOCK - len(data) if not data else -len(data) % BLOCK)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]
        # One row a batch for long texts: a batch's bytes stay near the limit.
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size < 1 << 22):
                size += len(texts[to])
                to += 1
            media = [mux(padded(t)) for t in texts[at:to]]
            yield pa.RecordBatch.from_arrays([b.column("id").slice(at, to - at), pa.array([len(t) for t in texts[at:to]], pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])
            at = to


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for m in b.column("media").to_pylist():
            m = m or b""
            stream = parse(m)
            data = b"".join(d for pid in sorted(stream.streams) for d in stream.streams[pid].data)
            rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-BLOCK:]), len(m), hashlib.sha256(m).hexdigest(), feature(stream)))
        columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_bytes"), *columns], ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and media: each text's UTF-8 bytes, filled with zeros to a positive multiple of 64, as a transport
    stream. A null text counts as empty; a long one is stored whole. Repeated rows repeat. Other columns are not read."""
    small_batches(docs.sparkSession, 1000, "4m")
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(_store, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def read_media(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digests and features of a media column (id, n_bytes, media); a null stream counts as one without packets."""
    source = media.withColumnRenamed(id_col, "id").select("id", "n_bytes", "media")
    kind = source.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return source.mapInArrow(_read, schema).withColumnRenamed("id", id_col)


def op2_transport_stream(spark, sf_dir: str) -> DataFrame:
    return read_media(store_texts(table(spark, sf_dir, "documents")))
