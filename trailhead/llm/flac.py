"""Media columns: FLAC streams written, verified and read back in numpy.

All frames of a batch are coded at once: the Rice decoder steps through the samples of
every frame in parallel, and predictors are restored the same way, so the cost for each
sample is that of a few array operations. A stream is mono with up to 16 bits a sample in
blocks of one size. Subframes may be constant, verbatim, fixed (orders 0 to 4) or LPC (up
to order 8 as written, 32 as read); residuals may have any partition order and escapes.
The reader verifies each header's CRC-8, each frame's CRC-16 and the stream's MD5, and
raises ValueError where one fails. Every stream has a seek table with a point for each
frame, so a PCM block can be read by its sample offset alone.

Null texts count as empty; an empty text is one block of padding; repeated texts give
equal values; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailhead.llm import base

BLOCK = 576
RATE = 8000
LPC_ORDER, PRECISION = 8, 10
#: Most frames coded at once; bounds the memory of a task.
_FRAMES = 4096
#: Block sizes that a frame header names by a code.
_SIZE_CODES = {192: 1, 576: 2, 1152: 3, 2304: 4, 4608: 5, 256: 8, 512: 9, 1024: 10, 2048: 11, 4096: 12}
_BITS_CODES = {8: 1, 12: 2, 16: 4}
#: Coefficients of the fixed predictors of orders 0 to 4.
_FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out = []
    for value in range(256):
        value <<= bits - 8
        for _ in range(8):
            value = (value << 1) ^ (poly if value >> (bits - 1) & 1 else 0)
            value &= (1 << bits) - 1
        out.append(value)
    return np.array(out, np.uint16)


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_ZEROS16 = np.array([16 if x == 0 else 16 - x.bit_length() for x in range(1 << 16)], np.int64)


def _right_aligned(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows of bytes, zeros in front: they leave a CRC that begins at 0 as it is. One row for each step."""
    width = int((ends - starts).max())
    at = ends[None, :] - width + np.arange(width)[:, None]
    return np.where(at >= starts[None, :], data[np.maximum(at, 0)], 0).astype(np.uint16)


def _crc16(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    crc = np.zeros(len(starts), np.uint16)
    for column in _right_aligned(data, starts, ends):
        crc = (crc << np.uint16(8)) ^ _CRC16[(crc >> np.uint16(8)) ^ column]
    return crc


def _crc8(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    crc = np.zeros(len(starts), np.uint16)
    for column in _right_aligned(data, starts, ends):
        crc = _CRC8[crc ^ column]
    return crc


def _number(n: int) -> bytes:
    """A frame number in the extended UTF-8 of frame headers."""
    if n < 0x80:
        return bytes([n])
    out = []
    lead = 0x3F
    while n > lead:
        out.append(0x80 | n & 0x3F)
        n >>= 6
        lead >>= 1
    return bytes([(~lead << 1 | n) & 0xFF, *reversed(out)])


def _lpc(x: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients and shift of each row's linear predictor."""
    n, size = x.shape
    window = np.hanning(size + 2)[1:-1].astype(np.float32)
    w = x.astype(np.float32) * window
    r = np.stack([np.einsum("ij,ij->i", w[:, : size - k], w[:, k:]) for k in range(order + 1)], 1).astype(np.float64)
    r[:, 0] = r[:, 0] * 1.0001 + 1
    a, error = np.zeros((n, order)), r[:, 0].copy()
    for i in range(order):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(1)) / error
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        error = np.maximum(error * (1 - k * k), 1e-6)
    top = np.maximum(np.abs(a).max(1), 1e-6)
    shift = np.clip(PRECISION - 1 - np.ceil(np.log2(top)).astype(np.int64), 0, 15)
    limit = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(a * np.exp2(shift)[:, None]), -limit, limit).astype(np.int64), shift


def _zigzag(x: np.ndarray) -> np.ndarray:
    return (x << 1) ^ (x >> 31)


def _put(bits: np.ndarray, rows: np.ndarray, at: np.ndarray, value: np.ndarray, width: int) -> None:
    """Writes value in so many bits at each row's offset."""
    for b in range(width):
        bits[rows, at + b] = (value >> (width - 1 - b)) & 1


def _frames(x: np.ndarray, depth: int, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all frames of the rows of samples x, and their lengths."""
    n, size = x.shape
    x = x.astype(np.int32)
    plain = depth * size
    kind, bits_least = np.zeros(n, np.int64), np.full(n, plain, np.int64)  # kind 0: verbatim
    shift = np.zeros(n, np.int64)

    def rice(residual: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Best parameter of each row and about the bits it takes."""
        u = np.abs(residual[:, order:]).sum(1, dtype=np.int64) * 2
        m = size - order
        k = np.clip(np.floor(np.log2(np.maximum(u / max(m, 1), 1e-9) * 0.7 + 1e-9)), 0, 14).astype(np.int64)
        return k, m * (k + 1) + (u >> k) + 10 + order * depth

    residual, best_k = x.copy(), np.zeros(n, np.int64)
    diff = x
    for order in range(min(5, size)):
        if order:
            nxt = diff.copy()
            nxt[:, 1:] = diff[:, 1:] - diff[:, :-1]
            diff = nxt
        k, bits = rice(diff, order)
        better = bits < bits_least
        bits_least[better], kind[better], best_k[better] = bits[better], 8 + order, k[better]
        residual[better] = diff[better]
    order = LPC_ORDER
    coefficients = np.zeros((n, order), np.int64)
    if size > 2 * order:
        coefficients, s = _lpc(x, order)
        c = coefficients.astype(np.int32)
        sums = np.zeros((n, size - order), np.int32)
        for j in range(order):
            sums += c[:, j, None] * x[:, order - 1 - j : size - 1 - j]
        made = x.copy()
        made[:, order:] -= sums >> s.astype(np.int32)[:, None]
        k, bits = rice(made, order)
        bits += 9 + order * PRECISION
        better = bits < bits_least
        bits_least[better], kind[better], best_k[better], shift[better] = bits[better], 31 + order, k[better], s[better]
        residual[better] = made[better]
    kind[(x == x[:, :1]).all(1)] = -1  # constant
    orders = np.where(kind >= 32, kind - 31, np.where(kind >= 8, kind - 8, 0))

    coded = np.flatnonzero(kind >= 8)
    u = _zigzag(residual[coded]).astype(np.int64)
    k_of = best_k[coded]
    lengths = (u >> k_of[:, None]) + 1 + k_of[:, None]
    skip = np.arange(size)[None, :] < orders[coded][:, None]
    lengths[skip] = 0
    lead = 8 + orders[coded] * depth + np.where(kind[coded] >= 32, 9 + orders[coded] * PRECISION, 0)
    total = lead + 10 + lengths.sum(1)
    kind[coded[total > plain + 8]] = 0  # the estimate was too low
    stays = total <= plain + 8
    coded, u, k_of, lengths, lead, total, skip = coded[stays], u[stays], k_of[stays], lengths[stays], lead[stays], total[stays], skip[stays]

    width = (plain + 8 + 7) // 8 * 8
    bits = np.zeros((n, width), np.uint8)
    used = np.zeros(n, np.int64)
    everyone = np.arange(n)
    header = np.where(kind == -1, 0, np.where(kind == 0, 1, kind))
    _put(bits, everyone, np.ones(n, np.int64), header, 6)
    mask = (1 << depth) - 1
    rows = np.flatnonzero(kind == -1)
    _put(bits, rows, np.full(len(rows), 8), x[rows, 0] & mask, depth)
    used[rows] = 8 + depth
    rows = np.flatnonzero(kind == 0)
    if len(rows):
        whole = (x[rows] & mask)[:, :, None] >> np.arange(depth - 1, -1, -1)[None, None, :] & 1
        bits[rows, 8 : 8 + plain] = whole.reshape(len(rows), plain)
        used[rows] = 8 + plain
    for o in np.unique(orders[coded]):
        mine = coded[orders[coded] == o]
        for j in range(o):
            _put(bits, mine, np.full(len(mine), 8 + j * depth), x[mine, j] & mask, depth)
    linear = coded[kind[coded] >= 32]
    at = np.full(len(linear), 8 + LPC_ORDER * depth)
    _put(bits, linear, at, np.full(len(linear), PRECISION - 1), 4)
    _put(bits, linear, at + 4, shift[linear], 5)
    for j in range(LPC_ORDER):
        _put(bits, linear, at + 9 + j * PRECISION, coefficients[linear, j] & ((1 << PRECISION) - 1), PRECISION)
    _put(bits, coded, lead + 6, k_of, 4)  # method 0 and partition order 0 are zeros
    flat = bits.reshape(-1)
    place = coded[:, None] * width + (lead + 10)[:, None] + np.cumsum(lengths, 1) - lengths
    for k in np.unique(k_of):
        mine = k_of == k
        keep = ~skip[mine]
        values, stop = u[mine][keep], (place[mine] + (u[mine] >> k))[keep]
        flat[stop] = 1
        for b in range(k):
            flat[stop + 1 + b] = values >> (k - 1 - b) & 1
    used[coded] = total

    body = np.packbits(bits, axis=1)
    body_len = (used + 7) // 8
    heads = [bytes([0xFF, 0xF8, _SIZE_CODES[size] << 4, _BITS_CODES[depth] << 1]) + _number(int(i)) for i in numbers]
    head_len = np.fromiter(map(len, heads), np.int64, n)
    ends = np.cumsum(head_len)
    crc8 = _crc8(np.frombuffer(b"".join(heads), np.uint8), ends - head_len, ends)
    wide = int(head_len.max()) + 1
    head = np.zeros((n, wide), np.uint8)
    head[np.arange(wide)[None, :] < head_len[:, None]] = np.frombuffer(b"".join(heads), np.uint8)
    head[everyone, head_len] = crc8
    head_len += 1
    both = np.concatenate([head, body, np.zeros((n, 2), np.uint8)], 1)
    columns = np.arange(both.shape[1])[None, :]
    there = (columns < head_len[:, None]) | (columns >= wide) & (columns < wide + body_len[:, None]) | (columns >= both.shape[1] - 2)
    out = both[there]
    size_of = head_len + body_len + 2
    ends = np.cumsum(size_of)
    crc = _crc16(out, ends - size_of, ends - 2)
    out[ends - 2], out[ends - 1] = crc >> np.uint16(8), crc & np.uint16(0xFF)
    return out, size_of


def encode(streams: list[np.ndarray], depth: int = 8, block: int = BLOCK) -> list[bytes]:
    """A FLAC stream for each array of signed samples; lengths are positive multiples of the block."""
    counts = [len(s) // block for s in streams]
    numbers = np.concatenate([np.arange(c) for c in counts]) if streams else np.zeros(0, np.int64)
    x = np.concatenate(streams).reshape(-1, block) if streams else np.zeros((0, block), np.int32)
    made = [_frames(x[i : i + _FRAMES], depth, numbers[i : i + _FRAMES]) for i in range(0, len(x), _FRAMES)]
    data = np.concatenate([m[0] for m in made]) if made else np.zeros(0, np.uint8)
    sizes = np.concatenate([m[1] for m in made]) if made else np.zeros(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    out, f = [], 0
    sample = np.int8 if depth == 8 else "<i2"
    points = np.dtype([("first", ">u8"), ("offset", ">u8"), ("samples", ">u2")])
    for stream, count in zip(streams, counts, strict=True):
        own = sizes[f : f + count]
        packed = RATE << 44 | 0 << 41 | (depth - 1) << 36 | len(stream)
        info = struct.pack(">HH", block, block) + int(own.min()).to_bytes(3, "big") + int(own.max()).to_bytes(3, "big") + packed.to_bytes(8, "big") + hashlib.md5(stream.astype(sample).tobytes(), usedforsecurity=False).digest()
        table = np.zeros(count, points)
        table["first"], table["offset"], table["samples"] = np.arange(count) * block, offsets[f : f + count] - offsets[f], block
        seek = table.tobytes()
        out.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + data[offsets[f] : offsets[f + count]].tobytes())
        f += count
    return out


def _stream_info(media: bytes) -> dict:
    """Figures of STREAMINFO, the seek table and where the frames start."""
    if media[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, found = 4, {"seek": None}
    while True:
        kind, size = media[at], int.from_bytes(media[at + 1 : at + 4], "big")
        body = media[at + 4 : at + 4 + size]
        if kind & 0x7F == 0:
            packed = int.from_bytes(body[10:18], "big")
            found |= {"block": int.from_bytes(body[:2], "big"), "depth": (packed >> 36 & 31) + 1, "channels": (packed >> 41 & 7) + 1, "samples": packed & (1 << 36) - 1, "md5": body[18:34]}
        elif kind & 0x7F == 3:
            found["seek"] = np.frombuffer(body, np.dtype([("first", ">u8"), ("offset", ">u8"), ("samples", ">u2")]))
        at += 4 + size
        if kind & 0x80:
            return found | {"at": at}


def _take(window: np.ndarray, p: np.ndarray, width) -> np.ndarray:
    """Unsigned bits of the given width (up to 57) at each bit offset."""
    v = window[p >> 3].astype(np.uint64) << (p & 7).astype(np.uint64)
    width = np.asarray(width, np.int64)
    return np.where(width > 0, v >> (64 - np.maximum(width, 1)).astype(np.uint64), 0).astype(np.int64)


def _signed(value: np.ndarray, width) -> np.ndarray:
    top = np.int64(1) << (np.asarray(width, np.int64) - 1).clip(0)
    return (value ^ top) - top


def _decode_frames(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, depth: int, block: int) -> np.ndarray:
    """Samples of all frames of a buffer, one row for each step of time."""
    n = len(starts)
    if (data[starts] != 0xFF).any() or (data[starts + 1] & 0xFE != 0xF8).any():
        raise ValueError("a frame lacks its sync code")
    crc = _crc16(data, starts, ends - 2)
    if (crc != data[ends - 2].astype(np.uint16) << np.uint16(8) | data[ends - 1]).any():
        raise ValueError("CRC-16 of a frame does not match")
    lead = data[starts + 4]
    follow = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC], [0, 1, 2, 3, 4], 5)
    code = data[starts + 2] >> 4
    body = starts + 5 + follow + np.select([code == 6, code == 7], [1, 2], 0)
    if (_crc8(data, starts, body) != data[body]).any():
        raise ValueError("CRC-8 of a header does not match")
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    window = np.ndarray((len(padded) - 7,), ">u8", padded, strides=(1,))
    p = (body + 1) * 8
    head = _take(window, p, 8)
    kind = head >> 1 & 63
    if (head & 1).any():
        raise ValueError("wasted bits are not supported")
    p = p + 8
    constant, verbatim = kind == 0, kind == 1
    fixed, linear = (kind >= 8) & (kind <= 12), kind >= 32
    if not (constant | verbatim | fixed | linear).all():
        raise ValueError("reserved type of subframe")
    order = np.where(fixed, kind - 8, np.where(linear, kind - 31, 0))
    most = int(order.max()) if n else 0
    x = np.zeros((block + most, n), np.int32)  # most rows of history in front
    for i in range(most):  # warm-up samples
        mine = np.flatnonzero(i < order)
        x[most + i, mine] = _signed(_take(window, p[mine], depth), depth)
        p[mine] += depth
    weights = np.zeros((most, n), np.int32)
    shift = np.zeros(n, np.int64)
    for o in range(1, min(5, most + 1)):
        weights[:o, fixed & (order == o)] = np.array(_FIXED[o], np.int32)[:, None]
    mine = np.flatnonzero(linear)
    if len(mine):
        precision = _take(window, p[mine], 4) + 1
        shift[mine] = _take(window, p[mine] + 4, 5)
        p[mine] += 9
        for j in range(most):
            has = j < order[mine]
            rows = mine[has]
            weights[j, rows] = _signed(_take(window, p[rows], precision[has]), precision[has])
            p[rows] += precision[has]
    rows = np.flatnonzero(constant)
    x[most:, rows] = _signed(_take(window, p[rows], depth), depth)[None, :]
    rows = np.flatnonzero(verbatim)
    for i in range(block if len(rows) else 0):
        x[most + i, rows] = _signed(_take(window, p[rows] + i * depth, depth), depth)

    rows = np.flatnonzero(fixed | linear)
    if len(rows):
        p, own, weights, shift = p[rows], order[rows], weights[:, rows], shift[rows].astype(np.int32)
        method = _take(window, p, 2)
        parts = block >> _take(window, p + 2, 4)  # samples of a partition
        p = p + 6
        bits_of_k = np.where(method == 1, 5, 4)
        k, raw = np.zeros(len(rows), np.int64), np.full(len(rows), -1)
        past = np.zeros((most + block, len(rows)), np.int32)
        past[: most + most] = x[: most + most, rows]
        same = (own == own[0]).all()
        for i in range(int(own.min()), block):
            live = slice(None) if same or i >= most else np.flatnonzero(i >= own)
            opens = np.flatnonzero(((i % parts == 0) | (i == own)) & (i >= own))
            if len(opens):
                k[opens] = _take(window, p[opens], bits_of_k[opens])
                p[opens] += bits_of_k[opens]
                escape = k[opens] == (1 << bits_of_k[opens]) - 1
                raw[opens] = np.where(escape, _take(window, p[opens], 5), -1)
                p[opens[escape]] += 5
            q_at, kk = p[live], k[live]
            v = window[q_at >> 3].astype(np.uint64) << (q_at & 7).astype(np.uint64)
            q = _ZEROS16[(v >> np.uint64(48)).astype(np.int64)]
            far = np.flatnonzero(q == 16)
            step = q.copy()
            while len(far):  # long runs of zeros
                more = _ZEROS16[_take(window, q_at[far] + step[far], 16)]
                step[far] += more
                far = far[(more == 16) & (step[far] < 1 << 20)]
            long = np.flatnonzero(step >= 16)
            q = step
            low = (v << (q.clip(0, 40) + 1).astype(np.uint64)) >> (63 - kk).astype(np.uint64) >> np.uint64(1)
            if len(long):
                low = low.astype(np.int64)
                low[long] = _take(window, q_at[long] + q[long] + 1, kk[long])
            u = (q << kk) | low.astype(np.int64)
            r = (u >> 1) ^ -(u & 1)
            moved = q + 1 + kk
            plain = raw[live] >= 0
            if plain.any():
                r = np.where(plain, _signed(_take(window, q_at, raw[live]), raw[live]) * (raw[live] > 0), r)
                moved = np.where(plain, raw[live], moved)
            p[live] = q_at + moved
            if most:
                before = past[i : i + most][::-1]
                guess = np.einsum("ij,ij->j", weights, before) >> shift
                past[most + i, live] = r + guess[live]
            else:
                past[i, live] = r
        x[:, rows] = past
    return x[most:]


def decode(media: list[bytes]) -> list[np.ndarray]:
    """Samples of each stream, verified against its checksums."""
    infos = [_stream_info(m) for m in media]
    out: list[np.ndarray] = []
    at = 0
    while at < len(media):
        first, frames = infos[at], 0
        end = at
        while end < len(media) and (infos[end]["depth"], infos[end]["block"]) == (first["depth"], first["block"]) and (end == at or frames + len(infos[end]["seek"]) <= _FRAMES):
            if infos[end]["channels"] != 1 or infos[end]["seek"] is None:
                raise ValueError("only mono streams with a seek table are read")
            frames += len(infos[end]["seek"])
            end += 1
        bodies = [m[i["at"] :] for m, i in zip(media[at:end], infos[at:end], strict=True)]
        shifts = np.concatenate([[0], np.cumsum([len(b) for b in bodies])])
        starts = np.concatenate([i["seek"]["offset"].astype(np.int64) + s for i, s in zip(infos[at:end], shifts[:-1], strict=True)])
        ends = np.append(starts[1:], shifts[-1])
        data = np.frombuffer(b"".join(bodies), np.uint8)
        rows = [_decode_frames(data, starts[i : i + _FRAMES], ends[i : i + _FRAMES], first["depth"], first["block"]) for i in range(0, len(starts), _FRAMES)]
        samples = np.concatenate([np.ascontiguousarray(r.T) for r in rows]).reshape(-1)
        f = 0
        for info in infos[at:end]:
            size = len(info["seek"]) * first["block"]
            own = samples[f : f + size][: info["samples"]]
            f += size
            if hashlib.md5(own.astype(np.int8 if first["depth"] == 8 else "<i2").tobytes(), usedforsecurity=False).digest() != info["md5"]:
                raise ValueError("MD5 of a stream does not match")
            out.append(own)
        at = end
    return out


def block_at(media: bytes, sample: int) -> tuple[int, np.ndarray]:
    """First sample and samples of the PCM block that holds the given sample; nothing else is decoded."""
    info = _stream_info(media)
    table = info["seek"]
    i = int(np.searchsorted(table["first"], sample, "right")) - 1
    start = info["at"] + int(table["offset"][i])
    end = info["at"] + int(table["offset"][i + 1]) if i + 1 < len(table) else len(media)
    data = np.frombuffer(media, np.uint8)
    return int(table["first"][i]), _decode_frames(data, np.array([start]), np.array([end]), info["depth"], info["block"])[:, 0]


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the FLAC stream of each text's bytes, padded with bytes 255 to whole blocks."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = [t.encode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            streams = [np.frombuffer(t + b"\xff" * (BLOCK - len(t) % BLOCK if len(t) % BLOCK or not t else 0), np.uint8).astype(np.int16) - 128 for t in texts]
            yield base.batch_of({"doc_id": batch.column(0), "n_bytes": [len(t) for t in texts], "media": encode(streams)}, schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), base.text_or_empty().alias("text"))
    return base.arrow_map(rows, run, "doc_id long, n_bytes long, media binary")


def stored(docs: DataFrame) -> DataFrame:
    """``store``, written to a table in the shared folder and read back."""
    return base.materialise(store(docs), "media", compression="zstd")


def pcm(media: DataFrame) -> DataFrame:
    """The decoded streams of ``store``: doc_id, n_bytes, media_bytes, media_sha256, feature, first_samples, offsets and pcm.

    pcm holds the unsigned 8-bit samples of all blocks in a row; block i begins at sample
    first_samples[i] and its frame at byte offsets[i] of the stream, so either can be sought.
    """
    schema = pa.schema(
        [
            ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()),
            ("first_samples", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("pcm", pa.binary()),
        ]
    )

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            streams = batch.column(2).to_pylist()
            infos = [_stream_info(m) for m in streams]
            decoded = decode(streams)
            yield base.batch_of(
                {
                    "doc_id": batch.column(0), "n_bytes": batch.column(1), "media_bytes": [len(m) for m in streams], "media_sha256": [hashlib.sha256(m).hexdigest() for m in streams],
                    "feature": [features(d) for d in decoded], "first_samples": [i["seek"]["first"].astype(np.int64) for i in infos],
                    "offsets": [i["at"] + i["seek"]["offset"].astype(np.int64) for i in infos], "pcm": [(d + 128).astype(np.uint8).tobytes() for d in decoded],
                },
                schema,
            )

    return base.arrow_map(
        media.select("doc_id", "n_bytes", "media"), run,
        "doc_id long, n_bytes long, media_bytes long, media_sha256 string, feature string, first_samples array<long>, offsets array<long>, pcm binary",
    )


def write_pcm(media: DataFrame) -> DataFrame:
    """``pcm``, written to a table in the shared folder and read back."""
    return base.materialise(pcm(media), "pcm", compression="zstd")


def pcm_blocks(media: DataFrame) -> DataFrame:
    """(doc_id, block, first_sample, pcm) of every stream: one row for each block of unsigned 8-bit samples."""
    rows = pcm(media).select("doc_id", F.posexplode("first_samples").alias("block", "first_sample"), F.col("pcm").alias("all_"))
    return rows.select("doc_id", "block", "first_sample", F.substring("all_", F.col("first_sample").cast("int") + 1, F.lit(BLOCK)).alias("pcm"))


def features(samples: np.ndarray) -> str:
    """Peak, root mean square, share of sign changes about the mean and mean step, as text."""
    x = samples.astype(np.float64)
    centred = x - x.mean()
    turns = np.count_nonzero(np.diff(np.signbit(centred))) / max(1, len(x) - 1)
    return f"peak={int(np.abs(samples).max())};rms={np.sqrt((x * x).mean()):.3f};turns={turns:.4f};step={np.abs(np.diff(x)).mean() if len(x) > 1 else 0:.3f}"


def described(media: DataFrame) -> DataFrame:
    """Digests of the streams of ``store`` and of the PCM blocks that they are decoded to."""
    return pcm(media).select(
        "doc_id", "n_bytes", F.length("pcm").cast("long").alias("payload_bytes"), F.sha2("pcm", 256).alias("payload_sha256"), F.crc32(F.substring("pcm", -32, 32)).alias("tail_crc32"),
        "media_bytes", "media_sha256", "feature", F.size("first_samples").cast("long").alias("n_blocks"),
    )
