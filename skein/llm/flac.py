"""FLAC coding of 8-bit mono PCM in numpy: whole batches of streams at once.

Writing: fixed predictors of order 0 to 2 and a quantised linear predictor compete for each frame, the
residual goes into four Rice partitions with their own parameter; constant and verbatim subframes where
they are shorter. The seek table has a point for every frame, or for as many evenly spaced ones as a table can hold.
Reading needs no table: without a point for every frame, frames are found by their sync codes and checksums.

Reading: the frames of all streams of a batch are decoded in lockstep - one residual of every frame per
numpy step - which makes the unary part of the Rice codes a vector operation. Frame headers are held
against their CRC-8, frames against their CRC-16, streams against the MD5 in STREAMINFO.
"""

from __future__ import annotations

import hashlib
import struct
from functools import lru_cache
from bisect import bisect_right

import numpy as np

BLOCK = 1024
RATE = 8000
LPC_ORDER = 4
LPC_BITS = 12
PARTITION_ORDER = 2


class FlacError(ValueError):
    """The stream is damaged or uses what 8-bit mono streams do not have."""


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out = []
    for b in range(256):
        c = b << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ (poly if c >> (bits - 1) & 1 else 0)) & ((1 << bits) - 1)
        out.append(c)
    return np.array(out, np.uint16)


_CRC8 = _crc_table(0x07, 8).tolist()
_CRC16 = _crc_table(0x8005, 16)
_FAR = [_CRC16]


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = _CRC8[c ^ b]
    return c


def _crc16_far(n: int) -> np.ndarray:
    """Row j: the CRC-16 of each byte with j zero bytes after it; CRC-16 is linear, so a frame's is their XOR."""
    while len(_FAR[0].shape) == 1 or len(_FAR[0]) < n:
        rows = [_CRC16] if _FAR[0].ndim == 1 else list(_FAR[0])
        while len(rows) < max(n, 2 * len(rows)) or len(rows) < n:
            last = rows[-1]
            rows.append((last << np.uint16(8)) ^ _CRC16[last >> np.uint16(8)])
            if len(rows) >= max(n, 1200):
                break
        _FAR[0] = np.array(rows, np.uint16)
    return _FAR[0]


def crc16_many(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of data[s:e] for each of the (disjoint, ascending, non-empty) ranges."""
    sizes = ends - starts
    if not len(sizes):
        return np.zeros(0, np.uint16)
    far = _crc16_far(int(sizes.max()))
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    within = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    bytes_ = data[within + np.repeat(starts, sizes)]
    return np.bitwise_xor.reduceat(far.reshape(-1)[(np.repeat(sizes - 1, sizes) - within) * 256 + bytes_], first)


def _coded_number(v: int) -> bytes:
    """The frame number in the UTF-8-like code of frame headers, up to 36 bits."""
    if v < 0x80:
        return bytes([v])
    for n in range(2, 8):
        if v < 1 << (5 * n + 1 if n < 7 else 36):
            break
    lead = (0xFF << (8 - n)) & 0xFF
    return bytes([lead | v >> (6 * (n - 1))] + [0x80 | (v >> (6 * j)) & 0x3F for j in range(n - 2, -1, -1)])


@lru_cache(100_000)
def frame_header(number: int, n: int) -> bytes:
    known = n == BLOCK
    head = bytes([0xFF, 0xF8, (10 if known else 7) << 4 | 4, 0x02]) + _coded_number(number) + (b"" if known else struct.pack(">H", n - 1))
    return head + bytes([crc8(head)])


def _parse_header(data, at: int) -> tuple[int, int, int]:
    """Length of the header at ``at``, frame number and block size; its CRC-8 is checked."""
    if data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
        raise FlacError("no frame here")
    size_code, rate_code = data[at + 2] >> 4, data[at + 2] & 15
    if data[at + 3] & 0xF0 or (data[at + 3] >> 1) & 7 not in (0, 1):
        raise FlacError("only 8-bit mono frames are read")
    p, lead = at + 4, data[at + 4]
    more = 0
    while lead & (0x80 >> more):
        more += 1
    number = lead & (0x7F >> more) if more else lead
    p += 1
    for _ in range(max(0, more - 1)):
        number, p = number << 6 | data[p] & 0x3F, p + 1
    if size_code == 1:
        n = 192
    elif size_code <= 5:
        n = 576 << (size_code - 2)
    elif size_code == 6:
        n, p = data[p] + 1, p + 1
    elif size_code == 7:
        n, p = (data[p] << 8 | data[p + 1]) + 1, p + 2
    else:
        n = 256 << (size_code - 8)
    p += {12: 1, 13: 2, 14: 2}.get(rate_code, 0)
    if crc8(data[at:p]) != data[p]:
        raise FlacError("CRC-8 of a frame header is wrong")
    return p + 1 - at, number, n


def _pack(pos: np.ndarray, value: np.ndarray, bits: np.ndarray, n_bytes: int) -> np.ndarray:
    """Bytes with each value (at most 16 bits) at its bit position; positions must not overlap."""
    at = pos >> 3
    v = value << (24 - (pos & 7).astype(value.dtype) - bits)
    out = np.bincount(at, v >> 16, n_bytes + 2)
    out += np.bincount(at + 1, (v >> 8) & 255, n_bytes + 2)
    out += np.bincount(at + 2, v & 255, n_bytes + 2)
    return out[:n_bytes].astype(np.uint8)


def _levinson(auto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Predictor coefficients of order LPC_ORDER for every row of autocorrelations, and the energy they leave."""
    err = auto[:, 0] * (1 + 1e-9) + 1e-3
    a = np.zeros((len(auto), LPC_ORDER))
    for i in range(LPC_ORDER):
        acc = auto[:, i + 1] - (a[:, :i] * auto[:, i:0:-1]).sum(1)
        k = acc / err
        prev = a[:, :i].copy()
        a[:, i] = k
        a[:, :i] = prev - k[:, None] * prev[:, ::-1]
        err = np.maximum(err * (1 - k * k), 1e-3)
    return a, err


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload; byte b is the sample b - 128. Payloads must not be empty."""
    lengths = np.array([len(p) for p in payloads], np.int64)
    flat = np.frombuffer(b"".join(payloads), np.uint8)
    s = flat.astype(np.int32) - 128
    per = -(-lengths // BLOCK)
    doc = np.repeat(np.arange(len(payloads)), per)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    doc_start = np.cumsum(lengths) - lengths
    start = doc_start[doc] + number * BLOCK
    n = np.minimum(BLOCK, lengths[doc] - number * BLOCK)
    frames = len(doc)
    within = np.arange(len(s), dtype=np.int32) - np.repeat(start.astype(np.int32), n)

    # Predictors: the signal's autocorrelation tells the energy that each would leave; the least wins.
    f = s.astype(np.float32)
    auto = np.zeros((frames, LPC_ORDER + 1))
    for lag in range(min(LPC_ORDER + 1, len(f))):
        prod = f[lag:] * f[: len(f) - lag]
        if lag:  # no products across the borders of frames
            for j in range(lag):
                edge = start - lag + j
                prod[edge[edge >= 0]] = 0
            prod = np.concatenate([np.zeros(lag, np.float32), prod])
        auto[:, lag] = np.add.reduceat(prod, start)
    a, err = _levinson(auto)
    a0, a1, a2 = auto[:, 0], auto[:, 1], auto[:, 2]
    energy = np.column_stack([a0, 2 * (a0 - a1), 6 * a0 - 8 * a1 + 2 * a2, err])
    kind = (np.log2(np.maximum(energy, 1)) * 0.5 * n[:, None] + np.array([0, 8, 16, 9 + (8 + LPC_BITS) * LPC_ORDER])).argmin(1)
    kind[n <= 2 * LPC_ORDER] = 0
    lpc = kind == 3
    order = np.array((0, 1, 2, LPC_ORDER))[kind]
    top = np.maximum(np.abs(a).max(1), 1e-6)
    shift = np.where(lpc, np.clip(LPC_BITS - 2 - np.floor(np.log2(top)).astype(np.int64), 0, 15), 0)
    limit = (1 << (LPC_BITS - 1)) - 1
    coef = np.clip(np.rint(a * (1 << shift)[:, None]), -limit, limit).astype(np.int32)
    fixed = np.zeros((3, LPC_ORDER), np.int32)
    fixed[1, 0], fixed[2, :2] = 1, (2, -1)
    coef = np.where(lpc[:, None], coef, fixed[np.minimum(kind, 2)])
    pred = np.zeros(len(s), np.int32)
    for j in range(LPC_ORDER):
        pred[j + 1 :] += np.repeat(coef[:, j], n)[j + 1 :] * s[: -(j + 1)]
    pred >>= np.repeat(shift.astype(np.int32), n)
    v = s - pred
    v = (v << 1) ^ (v >> 31)
    warm = within < np.repeat(order.astype(np.int32), n)
    v[warm] = 0
    constant = np.minimum.reduceat(s, start) == np.maximum.reduceat(s, start)
    # Rice partitions: the parameter that fits each partition's mean.
    parts = 1 << PARTITION_ORDER
    step = np.maximum(n >> PARTITION_ORDER, 1)
    plain_n = (n >> PARTITION_ORDER) << PARTITION_ORDER
    fits = plain_n == n
    p_start = (start[:, None] + np.arange(parts) * step[:, None]).ravel()
    p_start_safe = np.where(np.repeat(fits, parts), p_start, np.repeat(start, parts))
    p_sum = np.add.reduceat(v, np.minimum(p_start_safe, len(v) - 1)).astype(np.float64)
    p_count = np.repeat(step, parts).astype(np.float64)
    k = np.clip(np.floor(np.log2(np.maximum(p_sum / p_count, 1e-9)) + 0.4), 0, 14).astype(np.int32)
    p_size = np.repeat(step, parts)
    p_size[parts - 1 :: parts] += n - step * parts
    ks = np.repeat(k, p_size)
    q = v >> ks
    bits = q + 1 + ks
    bits[warm] = 0
    first_of_part = np.zeros(len(s), bool)
    first_of_part[np.minimum(p_start, len(s) - 1)] = True
    lead = first_of_part.astype(np.int32) << 2
    rice_bits = np.add.reduceat(bits + lead, start, dtype=np.int64)
    sub_bits = 8 + 8 * order + np.where(lpc, 9 + LPC_BITS * order, 0) + 6 + rice_bits
    verbatim = ((sub_bits >= 8 + 8 * n) | (n < 4 << PARTITION_ORDER) | ~fits) & ~constant
    coded = ~verbatim & ~constant
    sub_bits = np.where(constant, 16, np.where(verbatim, 8 + 8 * n, sub_bits))
    heads = [frame_header(int(i), int(m)) for i, m in zip(number, n, strict=True)]
    head_len = np.array([len(h) for h in heads], np.int64)
    size = head_len + (sub_bits + 7) // 8 + 2
    at = np.cumsum(size) - size
    base = (at + head_len) * 8
    total_bytes = int(size.sum())
    sub_type = np.where(constant, 0, np.where(verbatim, 1, np.where(lpc, 32 + LPC_ORDER - 1, 8 + order))) << 1
    # Words of up to 16 bits: subframe headers, warm-up, predictor, partition headers, Rice codes.
    words = [(base, sub_type, np.full(frames, 8))]
    rest = base + 8
    for j in range(LPC_ORDER):
        m = coded & (order > j)
        words.append(((rest + 8 * j)[m], (s[np.minimum(start + j, len(s) - 1)] & 255)[m], np.full(m.sum(), 8)))
    rest = rest + 8 * order
    m = coded & lpc
    words.append((rest[m], ((LPC_BITS - 1) << 5 | shift)[m], np.full(m.sum(), 9)))
    for j in range(LPC_ORDER):
        words.append(((rest + 9 + LPC_BITS * j)[m], (coef[:, j] & ((1 << LPC_BITS) - 1))[m].astype(np.int64), np.full(m.sum(), LPC_BITS)))
    rest = rest + np.where(lpc, 9 + LPC_BITS * order, 0)
    words.append((rest[coded], np.full(coded.sum(), PARTITION_ORDER), np.full(coded.sum(), 6)))
    rest = rest + 6
    ends = np.cumsum(bits + lead, dtype=np.int64)
    ends -= np.repeat(ends[start] - bits[start] - lead[start] - rest, n)
    pos = ends - bits - lead  # of the partition's parameter or the Rice code, whichever comes first
    use = np.repeat(coded, n)
    pm = use & first_of_part
    words.append((pos[pm], ks[pm], np.full(pm.sum(), 4)))
    m = constant
    words.append(((base + 8)[m], (s[start] & 255)[m], np.full(m.sum(), 8)))
    out = _pack(*(np.concatenate([w[i] for w in words]).astype(np.int64) for i in range(3)), total_bytes)
    use &= ~warm
    if not use.all():
        ends, ks, v = ends[use], ks[use], v[use]
    low = np.int32(1) << ks
    out += _pack(ends - ks - 1, low | (v & (low - 1)), ks + 1, total_bytes)
    for i in np.flatnonzero(verbatim):
        o = (base[i] >> 3) + 1
        out[o : o + n[i]] = (s[start[i] : start[i] + n[i]] & 255).astype(np.uint8)
    all_heads = np.frombuffer(b"".join(heads), np.uint8)
    h_first = np.cumsum(head_len) - head_len
    out[np.arange(len(all_heads)) - np.repeat(h_first, head_len) + np.repeat(at, head_len)] = all_heads
    crc = crc16_many(out, at, at + size - 2)
    out[at + size - 2], out[at + size - 1] = crc >> 8, crc & 255
    raw = out.tobytes()
    streams, frame_at = [], np.concatenate([[0], np.cumsum(per)])
    signed = (flat ^ 128).tobytes()
    for d, payload in enumerate(payloads):
        a0, a1 = frame_at[d], frame_at[d + 1]
        sizes = size[a0:a1]
        body = raw[at[a0] : at[a0] + int(sizes.sum())]
        md5 = hashlib.md5(signed[doc_start[d] : doc_start[d] + len(payload)]).digest()
        block = min(BLOCK, max(16, len(payload)))
        info = struct.pack(">HH", block, block) + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8, "big") + md5
        points = np.zeros(a1 - a0, np.dtype([("s", ">u8"), ("o", ">u8"), ("n", ">u2")]))
        points["s"], points["o"], points["n"] = number[a0:a1] * BLOCK, at[a0:a1] - at[a0], n[a0:a1]
        table = points[:: -(-len(points) // MAX_POINTS)].tobytes()
        streams.append(b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + body)
    return streams


#: Seek points that a metadata block of 24 bits of length has room for.
MAX_POINTS = ((1 << 24) - 1) // 18


class Stream:
    """Metadata of one stream: total samples, MD5, seek points and where the frames begin."""

    def __init__(self, media: bytes):
        if media[:4] != b"fLaC":
            raise FlacError("no FLAC stream")
        p, last, self.points, self.total = 4, False, None, 0
        while not last:
            last, kind, size = media[p] >> 7, media[p] & 127, int.from_bytes(media[p + 1 : p + 4], "big")
            p += 4
            if kind == 0:
                packed = int.from_bytes(media[p + 10 : p + 18], "big")
                self.total, self.md5 = packed & ((1 << 36) - 1), media[p + 18 : p + 34]
                if (packed >> 41) & 7 or (packed >> 36) & 31 != 7:
                    raise FlacError("only 8-bit mono streams are read")
            elif kind == 3:
                self.points = np.frombuffer(media[p : p + size], np.dtype([("s", ">u8"), ("o", ">u8"), ("n", ">u2")]))
            p += size
        self.frames_at = p

    def complete(self) -> bool:
        """Whether the seek table has a point for every frame."""
        return self.points is not None and len(self.points) > 0 and int(self.points["n"].astype(np.int64).sum()) == self.total

    def frames(self, media: bytes) -> np.ndarray:
        """First sample, offset behind the metadata and samples of every frame, from the table or else by a scan."""
        if self.complete():
            return self.points
        buf = np.frombuffer(media, np.uint8)
        maybe = np.flatnonzero((buf[self.frames_at : -1] == 0xFF) & (buf[self.frames_at + 1 :] & 0xFE == 0xF8)) + self.frames_at
        heads = {}
        for p in maybe.tolist():
            try:
                heads[p] = _parse_header(media, p)
            except (FlacError, IndexError):
                continue
        places, found, at, sample = [*heads, len(media)], [], self.frames_at, 0
        while at < len(media):
            if at not in heads:
                raise FlacError("no frame here")
            # A frame goes up to the first place where another begins, or the end, with its checksum before it.
            for end in places[bisect_right(places, at) :]:
                if int(crc16_many(buf, np.array([at]), np.array([end - 2]))[0]) == int(buf[end - 2]) << 8 | int(buf[end - 1]):
                    break
            else:
                raise FlacError("CRC-16 of a frame is wrong")
            found.append((sample, at - self.frames_at, heads[at][2]))
            at, sample = end, sample + heads[at][2]
        if self.total and sample != self.total:
            raise FlacError("the frames have another number of samples than the stream says")
        return np.array(found, np.dtype([("s", ">u8"), ("o", ">u8"), ("n", ">u4")]))


def _decode_frames(buf: np.ndarray, at: np.ndarray, end: np.ndarray, expect: np.ndarray, numbers: np.ndarray) -> list[np.ndarray]:
    """Samples of each frame buf[at:end], in lockstep over all of them; checks CRC-8, CRC-16, frame numbers and block sizes."""
    data = buf.tobytes()
    crc = crc16_many(buf, at, end - 2)
    if ((buf[end - 2].astype(np.int64) << 8 | buf[end - 1]) != crc).any():
        raise FlacError("CRC-16 of a frame is wrong")
    heads = [_parse_header(data, int(a)) for a in at]
    n = np.array([h[2] for h in heads], np.int64)
    if (n != expect).any():
        raise FlacError("a block has another size than its seek point says")
    if (np.array([h[1] for h in heads], np.int64) != numbers).any():
        raise FlacError("a frame is not in its place")
    padded = np.concatenate([buf, np.zeros(16, np.uint8)])
    window = np.ndarray((len(buf) + 8,), ">u8", padded.tobytes(), strides=(1,)).astype(np.uint64)

    def read(pos: np.ndarray, bits) -> np.ndarray:
        return ((window[pos >> 3] << (pos & 7).astype(np.uint64)) >> np.uint64(64) - np.asarray(bits).astype(np.uint64)).astype(np.int64)

    pos = (at + np.array([h[0] for h in heads], np.int64)) * 8
    head = read(pos, 8)
    if (head & 0x81).any():
        raise FlacError("wasted bits are not read")
    kind = head >> 1
    pos = pos + 8
    out: list = [None] * len(at)
    for i in np.flatnonzero(kind <= 1):
        b = pos[i] >> 3
        out[i] = np.full(n[i], buf[b].view(np.int8), np.int32) if kind[i] == 0 else buf[b : b + n[i]].view(np.int8).astype(np.int32)
    is_fixed, is_lpc = (kind >= 8) & (kind <= 12), kind >= 32
    if (~(is_fixed | is_lpc | (kind <= 1))).any():
        raise FlacError("reserved subframe type")
    order = np.where(is_fixed, kind - 8, np.where(is_lpc, kind - 31, 0))
    lanes = np.flatnonzero(kind >= 8)
    if not len(lanes):
        return out
    lanes = lanes[np.argsort(-(n[lanes] - order[lanes]), kind="stable")]
    p, o, m_n, lp = pos[lanes], order[lanes], n[lanes], is_lpc[lanes]
    most = int(o.max())
    warm = np.zeros((most, len(lanes)), np.int64)
    for j in range(most):
        warm[j] = np.where(o > j, (read(p + 8 * j, 8) ^ 128) - 128, 0)
    p = p + 8 * o
    precision = np.where(lp, read(p, 4) + 1, 0)
    shift = np.where(lp, read(p + 4, 5), 0)
    p = np.where(lp, p + 9, p)
    coef = np.zeros((most, len(lanes)), np.int64)
    for j in range(most):
        has = lp & (o > j)
        c = read(p + precision * j, np.maximum(precision, 1))
        coef[j] = np.where(has, c - ((c >> np.maximum(precision - 1, 0) & 1) << precision), 0)
    p = p + precision * np.where(lp, o, 0)
    method, part_order = read(p, 2), read(p + 2, 4)
    if (method > 1).any():
        raise FlacError("reserved residual coding")
    p = p + 6
    width = 4 + method
    span = m_n >> part_order
    count = m_n - o
    longest = int(count[0])
    turns = np.unique(np.concatenate([np.zeros(1, np.int64), *(np.unique(span * j - o) for j in range(1, int((1 << part_order).max())))]))
    turn_set = {int(t) for t in turns if 0 <= t < longest}
    residual = np.zeros((longest, len(lanes)), np.int32)
    k = np.zeros(len(lanes), np.int64)
    raw = np.full(len(lanes), -1)
    next_turn = np.zeros(len(lanes), np.int64)
    done = np.zeros(len(lanes), np.int64)
    active = np.searchsorted(-count, -np.arange(longest), side="left")  # lanes with more than t residuals
    for t in range(longest):
        m = int(active[t])
        if t in turn_set:
            while (due := np.flatnonzero((next_turn[:m] == t) & (done[:m] < (1 << part_order[:m])))).size:
                k[due] = read(p[due], width[due])
                p[due] += width[due]
                esc = due[k[due] == (1 << width[due]) - 1]
                raw[due] = -1
                if esc.size:
                    raw[esc] = read(p[esc], 5)
                    p[esc] += 5
                done[due] += 1
                next_turn[due] = span[due] * done[due] - o[due]
            any_raw = (raw[:m] >= 0).any()
        x, kk = p[:m], k[:m]
        w = window[x >> 3] << (x & 7).astype(np.uint64)
        top = (w >> np.uint64(32)).astype(np.float64)
        q = 1054 - (top.view(np.int64) >> 52)
        if not top.all():
            q = q.copy()
            for i in np.flatnonzero(top == 0):
                if any_raw and raw[i] >= 0:
                    continue
                y, zeros = int(x[i]), 0
                while not (v := int(window[y >> 3]) << (y & 7) & 0xFFFFFFFFFFFFFFFF) >> 32:
                    y, zeros = y + 32, zeros + 32
                lead = 64 - v.bit_length()
                q[i] = zeros + lead
                w[i] = np.uint64(v << lead & 0xFFFFFFFFFFFFFFFF)
            late = q > 31
            low = np.where(late, (w << np.uint64(1)) >> (64 - kk).astype(np.uint64), (w << (np.minimum(q, 62) + 1).astype(np.uint64)) >> (64 - kk).astype(np.uint64))
        else:
            low = (w << (q + 1).astype(np.uint64)) >> (64 - kk).astype(np.uint64)
        value = (q << kk) | low.astype(np.int64)
        used = q + 1 + kk
        value = (value >> 1) ^ -(value & 1)
        if any_raw:
            for i in np.flatnonzero(raw[:m] >= 0):
                bits = int(raw[i])
                c = int(read(x[i : i + 1], bits)[0]) if bits else 0
                value[i], used[i] = (c - ((c >> (bits - 1) & 1) << bits) if bits else 0), bits
        residual[t, :m] = value
        p[:m] += used
    for o_ in np.unique(o):
        for linear in (False, True):
            g = np.flatnonzero((o == o_) & (lp == linear))
            if not len(g):
                continue
            length = int(m_n[g].max())
            if not o_:
                samples = residual[:length, g]
            else:
                samples = np.zeros((length, len(g)), np.int32)
                samples[:o_] = warm[:o_, g]
                samples[o_:] = residual[: length - o_, g]
                if linear:
                    c, sh = coef[:, g].astype(np.int64), shift[g]
                    for t in range(o_, length):
                        acc = c[0] * samples[t - 1]
                        for j in range(1, o_):
                            acc += c[j] * samples[t - 1 - j]
                        samples[t] += (acc >> sh).astype(np.int32)
                else:
                    c = {1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}[int(o_)]
                    for t in range(o_, length):
                        for j, cj in enumerate(c):
                            samples[t] += cj * samples[t - 1 - j]
            rows = np.ascontiguousarray(samples.T)
            for lane, row in zip(g, rows, strict=True):
                out[lanes[lane]] = row[: m_n[lane]]
    return out


def decode_many(streams: list[bytes], check_md5: bool = True) -> list[bytes]:
    """The payload of each stream."""
    at, end, expect, numbers = [], [], [], []
    offset, infos = 0, [Stream(x) for x in streams]
    for media, info in zip(streams, infos, strict=True):
        frames = info.frames(media)
        first = frames["o"].astype(np.int64) + info.frames_at + offset
        at.append(first)
        end.append(np.append(first[1:], offset + len(media)))
        expect.append(frames["n"].astype(np.int64))
        numbers.append(np.arange(len(frames)))
        offset += len(media)
    if not streams:
        return []
    blocks = _decode_frames(np.frombuffer(b"".join(streams), np.uint8), *map(np.concatenate, (at, end, expect, numbers)))
    out, i = [], 0
    for info, mine in zip(infos, at, strict=True):
        signed = np.concatenate(blocks[i : i + len(mine)]).astype(np.int8).view(np.uint8)
        i += len(mine)
        if check_md5 and info.md5 != bytes(16) and hashlib.md5(signed.tobytes()).digest() != info.md5:  # zeros: not known
            raise FlacError("the samples do not have the MD5 of the stream")
        out.append((signed ^ 128).tobytes())
    return out


def read_samples(media: bytes, first: int, count: int) -> bytes:
    """``count`` samples from ``first`` on, decoding only the frames that hold them."""
    return read_many([media], [first], [count])[0]


def read_many(streams: list[bytes], firsts: list[int], counts: list[int]) -> list[bytes]:
    """``read_samples`` of each stream; the frames of all are decoded together, as a step of decoding costs the same for one frame as for many."""
    parts, at, end, expect, numbers, skips, offset = [], [], [], [], [], [], 0
    for media, first, count in zip(streams, firsts, counts, strict=True):
        info = Stream(media)
        frames = info.frames(media)
        starts, sizes = frames["s"].astype(np.int64), frames["n"].astype(np.int64)
        use = np.flatnonzero((starts < first + count) & (starts + sizes > first))
        places = frames["o"].astype(np.int64) + info.frames_at
        ends = np.append(places[1:], len(media))
        lo, hi = (int(places[use[0]]), int(ends[use[-1]])) if len(use) else (0, 0)
        parts.append(media[lo:hi])
        for column, values in ((at, places[use] - lo + offset), (end, ends[use] - lo + offset), (expect, sizes[use]), (numbers, use)):
            column.append(values)
        skips.append(max(0, first - int(starts[use[0]])) if len(use) else 0)
        offset += hi - lo
    if not offset:
        return [b""] * len(streams)
    blocks = _decode_frames(np.frombuffer(b"".join(parts), np.uint8), *map(np.concatenate, (at, end, expect, numbers)))
    out, i = [], 0
    for mine, skip, count in zip(at, skips, counts, strict=True):
        pcm = (np.concatenate(blocks[i : i + len(mine)]).astype(np.int8).view(np.uint8) ^ 128).tobytes() if len(mine) else b""
        i += len(mine)
        out.append(pcm[skip:][:count])
    return out
