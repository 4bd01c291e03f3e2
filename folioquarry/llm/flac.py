"""Media columns: mono FLAC streams, written and read for many rows at once.

All frames of a stretch of rows are handled side by side: one step takes the next sample of every frame. The reader
parses headers, checks CRC-8 and CRC-16 of each frame, decodes Rice residuals and undoes fixed or quantised linear
predictors; the decoded signal is held against the stream's MD5. The writer tries fixed predictors of orders 0 to 2 and
a linear predictor of order 4, and stores a frame verbatim where none is smaller. A seek table has one point a frame, so
a PCM block can be read from its sample offset without what comes before.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioquarry.llm.common import small_batches, views

BLOCK, UNIT, RATE = 576, 192, 16000  # samples of a frame; a payload's unit; samples a second
STRETCH = 1 << 19  # payload bytes handled at once
FIXED = np.array([[0, 0, 0, 0], [1, 0, 0, 0], [2, -1, 0, 0], [3, -3, 1, 0], [4, -6, 4, -1]], np.int64)
PRECISION, ORDER = 8, 4  # of the linear predictor's coefficients


def _table(poly: int, bits: int) -> np.ndarray:
    out, top = np.arange(256, dtype=np.int64) << (bits - 8), 1 << (bits - 1)
    for _ in range(8):
        out = np.where(out & top, (out << 1) ^ poly, out << 1) & ((1 << bits) - 1)
    return out


CRC8, CRC16 = _table(0x07, 8), _table(0x8005, 16)


def crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """The CRC of each span of bytes."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    at, size = starts[order], size[order]
    crc = np.zeros(len(at), np.int64)
    active = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), "left")  # spans longer than the step
    mask = (1 << bits) - 1
    for k, m in enumerate(active.tolist()):
        crc[:m] = (crc[:m] << 8 & mask) ^ table[(crc[:m] >> (bits - 8)) ^ data[at[:m] + k]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _put(bits: np.ndarray, at: np.ndarray, value: np.ndarray, width: int) -> None:
    for j in range(width):
        bits[at + j] = value >> (width - 1 - j) & 1


def _residual(x: np.ndarray, coef: np.ndarray, shift: np.ndarray, order: int) -> np.ndarray:
    """Of rows of samples; the first `order` columns are zero."""
    out = x.copy()
    if order:
        pred = np.zeros((len(x), x.shape[1] - order), np.int64)
        for j in range(order):
            pred += coef[:, j : j + 1] * x[:, order - 1 - j : x.shape[1] - 1 - j]
        out[:, order:] -= pred >> shift[:, None]
        out[:, :order] = 0
    return out


def _predictor(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(quantised coefficients, shift) of each row, from its autocorrelation by Levinson's recursion."""
    n, f = x.shape[1], x.astype(float)
    auto = [np.einsum("ij,ij->i", f[:, : n - k], f[:, k:]) for k in range(ORDER + 1)]
    err = auto[0] * 1.0001 + 1e-6
    a = np.zeros((len(x), ORDER))
    for i in range(ORDER):
        k = (auto[i + 1] - sum(a[:, j] * auto[i - j] for j in range(i))) / err
        new = a.copy()
        new[:, i] = k
        for j in range(i):
            new[:, j] = a[:, j] - k * a[:, i - 1 - j]
        a, err = new, np.maximum(err * (1 - k * k), 1e-6)
    top = np.abs(a).max(1)
    shift = np.clip(PRECISION - 2 - np.floor(np.log2(np.maximum(top, 1e-6))).astype(int), 0, 15)
    return np.clip(np.round(a * (1 << shift)[:, None]), -(1 << (PRECISION - 1)), (1 << (PRECISION - 1)) - 1).astype(np.int64), shift.astype(np.int64)


def _number(n: int) -> bytes:
    """A frame number in the form that UTF-8 gives characters, up to 36 bits."""
    if n < 0x80:
        return bytes([n])
    out: list[int] = []
    while True:
        out.append(0x80 | n & 0x3F)
        n >>= 6
        room = 6 - len(out)
        if n < 1 << max(room, 0) or len(out) == 6:
            return bytes([(0xFF << (7 - len(out))) & 0xFF | n, *reversed(out)])


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream of each payload's bytes, as 8-bit samples (byte - 128)."""
    data = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int64) - 128
    sizes = [len(p) for p in payloads]
    base = np.cumsum([0, *sizes])
    frames = [(r, k, int(base[r]) + a, min(BLOCK, sizes[r] - a)) for r in range(len(sizes)) for k, a in enumerate(range(0, sizes[r], BLOCK))]
    n = len(frames)
    if not n:
        return [_stream(p, [], []) for p in payloads]
    start, size = np.array([f[2] for f in frames]), np.array([f[3] for f in frames])
    heads = []
    for _, k, _, s in frames:
        code, extra = {192: (1, b""), 576: (2, b"")}.get(s) or (7, struct.pack(">H", s - 1))
        heads.append(bytes([0xFF, 0xF8, code << 4 | 5, 1 << 1]) + _number(k) + extra)
    head = np.array([len(h) for h in heads]) + 1
    kind, order, rice, body = (np.zeros(n, np.int64) for _ in range(4))  # kind: 0 verbatim, 1 fixed, 2 linear
    coef, shift = np.zeros((n, ORDER), np.int64), np.zeros(n, np.int64)
    codes: dict[int, np.ndarray] = {}
    for s in np.unique(size).tolist():
        which = np.flatnonzero(size == s)
        x = data[start[which][:, None] + np.arange(s)]
        best = np.full(len(which), 8 * s)
        chosen = x.copy()
        for kind_, order_ in ((1, 0), (1, 1), (1, 2), (2, ORDER)):
            if s <= order_:
                continue
            c, sh = _predictor(x) if kind_ == 2 else (np.repeat(FIXED[order_][None], len(which), 0), np.zeros(len(which), np.int64))
            e = _residual(x, c, sh, order_)
            u = (e << 1) ^ (e >> 63)
            side = 8 * order_ + 10 + (9 + PRECISION * order_ if kind_ == 2 else 0)
            near = np.clip(np.log2(np.maximum(u.sum(1) / s, 1)).astype(int), 1, 13)
            for d in (-1, 0, 1):
                k = near + d
                bits = side + (s - order_) * (1 + k) + (u >> k[:, None]).sum(1)
                won = bits < best
                if won.any():
                    best[won] = bits[won]
                    w = which[won]
                    kind[w], order[w], rice[w], coef[w], shift[w] = kind_, order_, k[won], c[won], sh[won]
                    chosen[won] = u[won]
        body[which] = best
        codes[s] = chosen
    bytes_ = head + (8 + body + 7) // 8 + 2
    frame_at = np.cumsum(bytes_) - bytes_
    bits = np.zeros(int(bytes_.sum()) * 8, np.uint8)
    at = (frame_at + head) * 8
    _put(bits, at, np.where(kind == 2, 0x40 | (order - 1) << 1, np.where(kind == 1, 0x10 | order << 1, 2)), 8)
    at = at + 8
    for s, chosen in codes.items():
        which = np.flatnonzero(size == s)
        x = data[start[which][:, None] + np.arange(s)] & 0xFF
        plain = kind[which] == 0
        if plain.any():
            for j in range(8):
                bits[at[which[plain]][:, None] + np.arange(s) * 8 + j] = x[plain] >> (7 - j) & 1
        for o in np.unique(order[which[~plain]]).tolist():
            for linear in (False, True):
                sel = ~plain & (order[which] == o) & ((kind[which] == 2) == linear)
                w = which[sel]
                if not len(w):
                    continue
                pos = at[w]
                for j in range(o):
                    _put(bits, pos, x[sel, j], 8)
                    pos = pos + 8
                if linear:
                    _put(bits, pos, np.full(len(w), PRECISION - 1), 4)
                    _put(bits, pos + 4, shift[w], 5)
                    pos = pos + 9
                    for j in range(o):
                        _put(bits, pos, coef[w, j], PRECISION)
                        pos = pos + PRECISION
                _put(bits, pos + 6, rice[w], 4)  # method 0 and partition order 0 before it
                pos = pos + 10
                u, k = chosen[sel][:, o:], rice[w][:, None]
                q = u >> k
                width = q + 1 + k
                first = pos[:, None] + np.cumsum(width, 1) - width + q
                bits[first] = 1
                for j in range(1, int(k.max()) + 1):
                    has = np.flatnonzero(k[:, 0] >= j)
                    bits[first[has] + j] = u[has] >> (k[has] - j) & 1
    out = np.packbits(bits)
    flat = np.frombuffer(b"".join(heads), np.uint8)
    size_h = head - 1
    src = np.repeat(np.cumsum(size_h) - size_h, size_h)
    out[np.repeat(frame_at, size_h) + np.arange(len(flat)) - src] = flat
    out[frame_at + size_h] = crcs(out, frame_at, frame_at + size_h, CRC8, 8)
    crc = crcs(out, frame_at, frame_at + bytes_ - 2, CRC16, 16)
    out[frame_at + bytes_ - 2], out[frame_at + bytes_ - 1] = crc >> 8, crc & 0xFF
    raw = out.tobytes()
    rows: list[list[int]] = [[] for _ in payloads]
    for k, f in enumerate(frames):
        rows[f[0]].append(k)
    ends = (frame_at + bytes_).tolist()
    return [_stream(p, [int(bytes_[k]) for k in r], [raw[frame_at[r[0]] : ends[r[-1]]]] if r else []) for p, r in zip(payloads, rows, strict=True)]


def _stream(payload: bytes, sizes: list[int], frames: list[bytes]) -> bytes:
    signed = (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()
    info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes, default=0).to_bytes(3, "big") + max(sizes, default=0).to_bytes(3, "big") + (RATE << 44 | 7 << 36 | len(payload)).to_bytes(8, "big") + hashlib.md5(signed).digest()
    at = np.cumsum([0, *sizes])[: len(sizes)]
    points = b"".join(struct.pack(">QQH", k * BLOCK, int(a), min(BLOCK, len(payload) - k * BLOCK)) for k, a in enumerate(at))
    return b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([0x83]) + len(points).to_bytes(3, "big") + points + b"".join(frames)


def parse(stream: bytes) -> tuple[int, bytes, int, list[tuple[int, int, int]]]:
    """(samples, MD5, first frame's byte, seek points as (sample, byte from there, samples)) of a mono 8-bit stream."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, total, md5, points = 4, False, 0, b"", []
    while not last:
        last, kind, size = stream[at] >= 128, stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        at += 4 + size
        if kind == 0:
            word = int.from_bytes(body[10:18], "big")
            if (word >> 41) & 7 or (word >> 36) & 31 != 7:
                raise ValueError("only mono 8-bit streams are handled")
            total, md5 = word & ((1 << 36) - 1), body[18:34]
        elif kind == 3:
            points = [p for p in struct.iter_unpack(">QQH", body) if p[0] != (1 << 64) - 1]
    return total, md5, at, points


def decode_frames(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(samples end to end, number of samples, frame number) of frames at byte spans of data."""
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = np.concatenate([data, np.zeros(4, np.uint8)])
    d = lambda x: data[x].astype(np.int64)
    if (d(starts) != 0xFF).any() or (d(starts + 1) != 0xF8).any():
        raise ValueError("no frame where one should start")
    code, first = d(starts + 2) >> 4, d(starts + 4)
    more = np.select([first < 0x80, first < 0xE0, first < 0xF0, first < 0xF8, first < 0xFC, first < 0xFE], [0, 1, 2, 3, 4, 5], 6)
    number = np.where(more == 0, first, first & ((1 << np.maximum(6 - more, 0)) - 1))
    for j in range(1, 7):
        number = np.where(more >= j, number << 6 | d(np.minimum(starts + 4 + j, len(data) - 1)) & 0x3F, number)
    at = starts + 5 + more
    size = np.select([code == 1, (code >= 2) & (code < 6), code == 6, code == 7], [192, 576 << np.clip(code - 2, 0, 3), d(at) + 1, (d(at) << 8 | d(at + 1)) + 1], 256 << np.clip(code - 8, 0, 7))
    at = at + np.select([code == 6, code == 7], [1, 2], 0)
    if (crcs(data, starts, at, CRC8, 8) != d(at)).any() or (crcs(data, starts, ends - 2, CRC16, 16) != (d(ends - 2) << 8 | d(ends - 1))).any():
        raise ValueError("a frame's checksum is wrong")
    pos = (at + 1) * 8
    word = data[:-3].astype(np.int64) << 24 | data[1:-2].astype(np.int64) << 16 | data[2:-1].astype(np.int64) << 8 | data[3:]

    def get(p: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        return word[p >> 3] >> (32 - (p & 7) - width) & ((np.int64(1) << width) - 1)

    def signed(v: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        return v - ((v >> (width - 1) & 1) << width)

    kind = get(pos, 8) >> 1
    pos = pos + 8
    linear, fixed = kind >= 32, (kind >= 8) & (kind < 13)
    if not (linear | fixed | (kind < 2)).all():
        raise ValueError("unknown subframe")
    order = np.where(linear, kind - 31, np.where(fixed, kind - 8, 0))
    most, long = int(order.max()), int(size.max())
    out = np.zeros((n, long + most), np.int64)  # samples after `most` zeros
    coded = linear | fixed
    for j in range(most):
        has = np.flatnonzero(coded & (order > j))
        out[has, most + j] = signed(get(pos[has], 8), 8)
        pos[has] += 8
    coef, shift = np.zeros((n, max(most, 4)), np.int64), np.zeros(n, np.int64)
    coef[fixed, :4] = FIXED[order[fixed]]
    precision = np.zeros(n, np.int64)
    precision[linear] = get(pos[linear], 4) + 1
    shift[linear] = get(pos[linear] + 4, 5)
    pos[linear] += 9
    for j in range(most):
        has = np.flatnonzero(linear & (order > j))
        coef[has, j] = signed(get(pos[has], precision[has]), precision[has])
        pos[has] += precision[has]
    coef = coef[:, :most]
    constant, verbatim = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
    if len(constant):
        out[constant, most:] = signed(get(pos[constant], 8), 8)[:, None]
    if len(verbatim):
        p = np.minimum(pos[verbatim][:, None] + 8 * np.arange(long), 8 * (len(word) - 1))
        out[verbatim, most:] = signed(get(p, 8), 8)
    rows = np.flatnonzero(coded)
    if len(rows):
        if (get(pos[rows], 2) > 1).any():
            raise ValueError("unknown residual coding")
        wide = np.where(get(pos[rows], 2) == 1, 5, 4)
        part = size[rows] >> get(pos[rows] + 2, 4)
        p, o, s = pos[rows] + 6, order[rows], size[rows]
        bits = np.unpackbits(data)
        after = np.where(bits, np.arange(len(bits), dtype=np.int32), np.int32(len(bits) - 1))
        after = np.minimum.accumulate(after[::-1])[::-1]  # the next set bit
        k = np.zeros(len(rows), np.int64)
        c, sh, res = coef[rows], shift[rows], out[rows]
        for t in range(long):
            now = (t < s) & (t >= o)
            fresh = (t < s) & ((t % part == 0) | (t == 0))
            if fresh.any():
                k = np.where(fresh, get(p, wide), k)
                p = p + np.where(fresh, wide, 0)
                if (fresh & (k == (1 << wide) - 1)).any():
                    raise ValueError("escaped partitions aren't handled")
            stop = after[p].astype(np.int64)
            u = (stop - p) << k | get(stop + 1, k)
            e = (u >> 1) ^ -(u & 1)
            if most:
                e = e + ((c * res[:, t : t + most][:, ::-1]).sum(1) >> sh)
            if now.all():
                p = stop + 1 + k
                res[:, t + most] = e
            else:
                p = np.where(now, stop + 1 + k, p)
                res[:, t + most] = np.where(now, e, res[:, t + most])
        out[rows] = res
    return out[:, most:][np.arange(long) < size[:, None]], size, number


def decode(streams: list[bytes]) -> list[np.ndarray]:
    """The samples of each stream, its frames found by its seek table, checksums and MD5 verified."""
    parsed = [parse(s) for s in streams]
    base = np.cumsum([0, *map(len, streams)])
    starts, ends, owner = [], [], []
    for r, (_, _, at, points) in enumerate(parsed):
        offsets = [int(base[r]) + at + p[1] for p in points]
        starts += offsets
        ends += [*offsets[1:], int(base[r + 1])] if offsets else []
        owner += [r] * len(offsets)
    data = np.frombuffer(b"".join(streams), np.uint8)
    parts, a = [], 0
    while a < len(starts):  # a decoder holds several bytes for each bit: frames of some STRETCH bytes at once
        b = a + 1
        while b < len(starts) and ends[b] - starts[a] <= STRETCH:
            b += 1
        parts.append(decode_frames(data[starts[a] : ends[b - 1]], np.array(starts[a:b], np.int64) - starts[a], np.array(ends[a:b], np.int64) - starts[a]))
        a = b
    samples, size, number = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(3))
    count = np.bincount(np.array(owner, int), size, len(streams)).astype(np.int64)
    cuts = np.cumsum([0, *count])
    out = []
    for r, (total, md5, _, _) in enumerate(parsed):
        x = samples[cuts[r] : cuts[r + 1]]
        if len(x) != total or hashlib.md5(x.astype(np.int8).tobytes()).digest() != md5:
            raise ValueError("the decoded samples aren't those that were stored")
        out.append(x)
    return out


def payload(text: bytes) -> bytes:
    """text with spaces up to a positive multiple of UNIT."""
    return text.ljust(max(UNIT, -(-len(text) // UNIT) * UNIT), b" ")


def features(x: np.ndarray) -> str:
    """Peak, energy, zero crossings and sum of absolute steps, as integers."""
    step = np.diff(x)
    return f"peak={int(np.abs(x).max(initial=0))};energy={int((x * x).sum())};crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())};steps={int(np.abs(step).sum())}"


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media (a FLAC stream of the whole text's payload). Null texts are stored as empty ones (all
    spaces); null ids and repeated rows stay; an empty table gives an empty result; other columns are not read."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in views(batch.column(1), STRETCH):
                raw = data.tobytes()
                media = encode([payload(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(np.diff(offsets), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def _groups(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    lo, held, size = 0, [], 0
    for k, x in enumerate(column):
        held.append(x.as_py())
        size += len(held[-1])
        if size >= STRETCH:
            yield lo, held
            lo, held, size = k + 1, [], 0
    if held:
        yield lo, held


def pcm_blocks(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """doc_id, sample_offset, n_samples, pcm (signed 8-bit): one row per frame, each checked. Rows with null media give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, held in _groups(batch.column(1)):
                which, at, pcm = [], [], []
                for r, x in enumerate(decode(held)):
                    for a in range(0, len(x), BLOCK):
                        which.append(lo + r)
                        at.append(a)
                        pcm.append(x[a : a + BLOCK].astype(np.int8).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which, pa.int64())), pa.array(at, pa.int64()), pa.array([len(p) for p in pcm], pa.int64()), pa.array(pcm, pa.binary())], names=["doc_id", "sample_offset", "n_samples", "pcm"])

    rows = media.where(F.col(media_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(media_col).alias("media"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, sample_offset long, n_samples long, pcm binary")


def read_at(stream: bytes, sample: int) -> tuple[int, np.ndarray]:
    """(sample offset, samples) of the block that holds a sample, read from the seek table alone."""
    _, _, at, points = parse(stream)
    k = max(i for i, p in enumerate(points) if p[0] <= sample)
    end = at + points[k + 1][1] if k + 1 < len(points) else len(stream)
    data = np.frombuffer(stream[at + points[k][1] : end], np.uint8)
    return points[k][0], decode_frames(data, np.array([0]), np.array([len(data)]))[0]


def pcm_rows(media: DataFrame) -> DataFrame:
    """stored()'s rows decoded and checked: doc_id, n_bytes, media_bytes, media_sha256, blocks (sample_offset, pcm), one
    block a frame, in order, so that any sample is found by its offset. A stream that fails a check raises; null media
    gives null columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.flatnonzero(np.array(batch.column(2).is_valid()))
            for lo, held in _groups(batch.column(2).drop_null()):
                rows = pa.array(at[lo : lo + len(held)])
                blocks = [[{"sample_offset": a, "pcm": x[a : a + BLOCK].astype(np.int8).tobytes()} for a in range(0, len(x), BLOCK)] for x in decode(held)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array([len(m) for m in held], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in held]), pa.array(blocks, pa.list_(pa.struct([("sample_offset", pa.int64()), ("pcm", pa.binary())])))], names=names)
            gone = batch.filter(batch.column(2).is_null())
            if len(gone):
                yield pa.RecordBatch.from_arrays([gone.column(0), gone.column(1), pa.nulls(len(gone), pa.int64()), pa.nulls(len(gone), pa.string()), pa.nulls(len(gone), pa.list_(pa.struct([("sample_offset", pa.int64()), ("pcm", pa.binary())])))], names=names)

    names = ["doc_id", "n_bytes", "media_bytes", "media_sha256", "blocks"]
    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {kind}, n_bytes long, media_bytes long, media_sha256 string, blocks array<struct<sample_offset: long, pcm: binary>>")


def block_at(blocks: str, sample: str) -> Column:
    """The block of a column of blocks that holds a sample."""
    return F.element_at(F.filter(blocks, lambda b: b["sample_offset"] <= F.col(sample)), -1)


def read_back(pcm: DataFrame) -> DataFrame:
    """Digests and features of pcm_rows(): doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature; the last ones null where there are no blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "feature")}
            for blocks in batch.column(4):
                if not blocks.is_valid:
                    for v in out.values():
                        v.append(None)
                    continue
                x = np.concatenate([np.frombuffer(b["pcm"], np.int8) for b in blocks.as_py()]).astype(np.int64)
                raw = (x + 128).astype(np.uint8).tobytes()
                out["payload_bytes"].append(len(raw))
                out["payload_sha256"].append(hashlib.sha256(raw).hexdigest())
                out["tail_crc32"].append(zlib.crc32(raw[-16:]))
                out["feature"].append(features(x))
            cols = [pa.array(out[k], t) for k, t in (("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *cols, batch.column(2), batch.column(3), pa.array(out["feature"], pa.string())], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = pcm.schema["doc_id"].dataType.simpleString()
    return pcm.select("doc_id", "n_bytes", "media_bytes", "media_sha256", "blocks").mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
