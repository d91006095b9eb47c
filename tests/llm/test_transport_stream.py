import hashlib
import os
import random
import zlib

from nestkit.llm.transport_stream import DATA_PID, PACKET, PMT_PID, PROGRAM, TICKS, UNIT, feature, mux, padded, parse, read_media, section_crc, store_texts, PAT, PMT

from .cases import ROWS, documents, empty


def data(stream):
    return b"".join(d for pid in sorted(stream.streams) for d in stream.streams[pid].data)


def test_round_trip_of_every_size():
    for n in [*range(0, 600), UNIT - 1, UNIT, UNIT + 1, 13 * UNIT + 77]:
        payload = os.urandom(n)
        media = mux(payload)
        stream = parse(media)
        es = stream.streams[DATA_PID]
        assert data(stream) == payload and len(media) % PACKET == 0 and media[::PACKET] == b"G" * stream.packets
        assert (stream.bad_packets, stream.bad_tables, es.counter_errors, es.duplicates, es.damaged) == (0, 0, 0, 0, [])
        assert stream.programs == {PROGRAM: PMT_PID} and es.pts == [k * TICKS for k in range(max(1, -(-n // UNIT)))]
        assert es.access == list(range(0, len(es.pts), 12))


def test_table_checksums():
    assert section_crc(PAT) == 0 and section_crc(PMT) == 0 and section_crc(b"123456789") == 0x0376E6E7


def test_lost_packet_is_noticed():
    media = mux(os.urandom(3 * UNIT))
    lost = media[: 50 * PACKET] + media[51 * PACKET :]
    es = parse(lost).streams[DATA_PID]
    assert es.counter_errors == 1 and es.damaged == [0] and len(es.data) == 3


def test_packet_sent_twice_is_dropped():
    payload = os.urandom(2 * UNIT)
    media = mux(payload)
    stream = parse(media[: 51 * PACKET] + media[50 * PACKET :])
    assert data(stream) == payload and stream.streams[DATA_PID].duplicates == 1 and stream.streams[DATA_PID].counter_errors == 0


def test_damage_never_fails():
    rng = random.Random(3)
    media = mux(os.urandom(5000))
    for _ in range(300):
        broken = bytearray(media)
        for _ in range(30):
            broken[rng.randrange(len(broken))] = rng.randrange(256)
        feature(parse(bytes(broken[: rng.randrange(len(broken))])))
    bad_table = bytearray(media)
    bad_table[10] ^= 1
    assert parse(bytes(bad_table)).bad_tables == 1 and parse(b"").packets == 0


def test_contract_columns(spark):
    got = read_media(store_texts(documents(spark))).collect()
    want = []
    for i, t, *_ in ROWS:
        p = padded((t or "").encode())
        m = mux(p)
        want.append((i, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature(parse(m))))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert all(r.payload_bytes % 64 == 0 and r.payload_bytes > 0 for r in got)
    assert read_media(store_texts(empty(spark))).count() == 0


def test_null_media(spark):
    row = read_media(spark.sql("select 1 doc_id, 0L n_bytes, cast(null as binary) media")).first()
    assert row.payload_bytes == 0 and row.media_bytes == 0
