import hashlib
import random
import zlib

import numpy as np
import pytest

from folioquarry.llm.flac import BLOCK, _number, crcs, CRC16, CRC8, decode, encode, parse, payload, block_at, pcm_blocks, pcm_rows, read_at, read_back, stored


def samples(p):
    return np.frombuffer(p, np.uint8).astype(int) - 128


def test_round_trip():
    rng = random.Random(2)
    texts = [b"", b"a", b"x" * 192, b"x" * 193, b"plain words of a text " * 300, bytes(range(256)) * 30, rng.randbytes(5000), "é日本🙂".encode() * 100, b"\xff\xf8" * 400]
    texts += [bytes(int(128 + 100 * np.sin(k / 9)) for k in range(4000)), b" " * 100_000]
    payloads = [payload(t) for t in texts]
    assert all(len(p) % 192 == 0 and len(p) > 0 and p.startswith(t) for p, t in zip(payloads, texts))
    streams = encode(payloads)
    for p, x in zip(payloads, decode(streams)):
        assert (x == samples(p)).all()
    assert encode([payloads[4]])[0] == streams[4]  # the same alone as among others
    assert len(streams[4]) < len(payloads[4])
    offset, block = read_at(streams[4], 1500)
    assert offset == 1500 // BLOCK * BLOCK and (block == samples(payloads[4])[offset : offset + BLOCK]).all()


def test_checksums():
    assert crcs(np.frombuffer(b"123456789", np.uint8), np.array([0]), np.array([9]), CRC8, 8)[0] == 0xF4
    assert crcs(np.frombuffer(b"123456789", np.uint8), np.array([0]), np.array([9]), CRC16, 16)[0] == 0xFEE8
    for n in (0, 127, 128, 0x7FF, 0x800, 0xFFFF, 0x10000, 0x10FFFF):
        if not 0xD800 <= n < 0xE000:
            assert _number(n) == chr(n).encode("utf-8", "surrogatepass")
    stream = encode([payload(b"some text " * 200)])[0]
    at = parse(stream)[2]
    for k in (at + 2, at + 20, len(stream) - 1):
        broken = bytearray(stream)
        broken[k] ^= 0x10
        with pytest.raises(ValueError):
            decode([bytes(broken)])


def test_partitions_and_constant():
    # A frame put together by hand: fixed order 1, two partitions with parameters 1 and 3; then a constant frame.
    x = [5, 6, 6, 5] + [20, 3, 40, 41]
    res = [x[k] - x[k - 1] for k in range(1, 8)]
    bits = "00010010" + f"{x[0]:08b}" + "00" + "0001"
    for k, part in ((1, res[:3]), (3, res[3:])):
        bits += f"{k:04b}"
        for e in part:
            u = 2 * e if e >= 0 else -2 * e - 1
            bits += "0" * (u >> k) + "1" + f"{u & (1 << k) - 1:0{k}b}"
    frames = []
    for number, body in enumerate((bits, "00000000" + f"{-7 & 255:08b}")):
        head = bytes([0xFF, 0xF8, 0x65, 0x02, number, 7])
        body += "0" * (-len(body) % 8)
        one = lambda d, t, b: int(crcs(np.frombuffer(d, np.uint8), np.array([0]), np.array([len(d)]), t, b)[0])
        frame = head + bytes([one(head, CRC8, 8)]) + int(body, 2).to_bytes(len(body) // 8, "big")
        frames.append(frame + one(frame, CRC16, 16).to_bytes(2, "big"))
    from folioquarry.llm.flac import decode_frames

    ends = np.cumsum([len(f) for f in frames])
    got, size, number = decode_frames(np.frombuffer(b"".join(frames), np.uint8), np.array([0, ends[0]]), ends)
    assert got.tolist() == x + [-7] * 8 and size.tolist() == [8, 8] and number.tolist() == [0, 1]


def test_query_columns(spark):
    rows = [(1, "some text " * 700), (1, "some text " * 700), (2, None), (2, ""), (None, "é" * 96), (3, "z" * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS media", "2 AS n_bytes")
    pcm = pcm_rows(stored(df))
    out = read_back(pcm).collect()
    assert len(out) == len(rows) and len({tuple(r) for r in out}) == 4
    for r in out:
        p = payload(next(t for k, t in rows if k == r.doc_id and len((t or "").encode()) == r.n_bytes).encode() if r.n_bytes else b"")
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    blocks = pcm_blocks(stored(df.where("doc_id = 3"))).orderBy("sample_offset").collect()
    assert b"".join(bytes(b.pcm) for b in blocks) == samples(payload(b"z" * 20_000)).astype(np.int8).tobytes()
    assert read_back(pcm_rows(stored(df.limit(0)))).count() == 0
    block = pcm.where("doc_id = 3").selectExpr("*", "9999 AS want").select(block_at("blocks", "want").alias("b")).first().b
    assert block.sample_offset == 9999 // BLOCK * BLOCK and bytes(block.pcm) == samples(payload(b"z" * 20_000)).astype(np.int8).tobytes()[block.sample_offset :][:BLOCK]
    gone = stored(df).selectExpr("doc_id", "n_bytes", "CASE WHEN n_bytes > 0 THEN media END AS media")
    assert sorted(r.n_bytes for r in read_back(pcm_rows(gone)).where("payload_sha256 IS NULL").collect()) == [0, 0]
