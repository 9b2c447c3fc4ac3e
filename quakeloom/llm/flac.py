"""FLAC streams in binary columns: lossless coding of 8-bit samples and decoding by blocks.

Frames are independent, so all frames of a batch of streams are handled side by side: arrays hold
one lane per frame and each step takes the next sample of every lane. The decoder reads constant,
verbatim, fixed and LPC subframes with partitioned Rice residuals (both parameter widths and raw
partitions), checks the CRC-8 of each header, the CRC-16 of each frame and the MD5 of the samples,
and gives PCM blocks with their sample and byte offsets. A seek table lists every frame, so a range
of samples is decoded from the frames that hold it.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textops import string_parts, slices

BLOCK = 1024
RATE = 8000
STEP_BYTES = 1 << 19
_FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
_SHIFT, _PRECISION = 8, 11
#: Kinds of subframes besides the fixed predictors of order 0 to 4.
_LPC, _VERBATIM, _CONSTANT = 5, -1, -2


def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    out = np.zeros(256, np.int64)
    for k in range(256):
        r = k << (bits - 8)
        for _ in range(8):
            r = (r << 1 ^ poly if r & top else r << 1) & mask
        out[k] = r
    return out


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _crc(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int) -> np.ndarray:
    """CRC of each span, all spans in step."""
    table = _CRC8 if bits == 8 else _CRC16
    out = np.zeros(len(starts), np.int64)
    order = np.argsort(starts - ends, kind="stable")
    at, left, now = starts[order].copy(), np.sort(ends - starts)[::-1], np.zeros(len(starts), np.int64)
    for t in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -t, "left"))
        if bits == 8:
            now[:n] = table[now[:n] ^ data[at[:n] + t]]
        else:
            now[:n] = (now[:n] << 8 & 0xFFFF) ^ table[now[:n] >> 8 ^ data[at[:n] + t]]
    out[order] = now
    return out


def _number(k: int) -> bytes:
    """A frame number in FLAC's extension of UTF-8."""
    if k < 0x80:
        return bytes([k])
    tail = []
    limit = 0x20
    while True:
        tail.append(0x80 | k & 0x3F)
        k >>= 6
        if k < limit:
            lead = (0xFF00 >> (len(tail) + 1)) & 0xFF
            return bytes([lead | k, *reversed(tail)])
        limit >>= 1


# --- encoding ----------------------------------------------------------------------------------


def _zigzag(x: np.ndarray) -> np.ndarray:
    return (x << 1) ^ (x >> 31)


def _rice_cost(u: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits, parameter) of the cheapest Rice code for each row of ``u``, whose padding is zero."""
    middle = np.log2(np.maximum(u.sum(axis=1, dtype=np.int64) / np.maximum(n, 1) * 0.7, 1)).astype(np.int32)
    tried = np.clip(middle + np.arange(-1, 2, dtype=np.int32)[:, None], 2, 8)
    costs = np.stack([(u >> k[:, None]).sum(axis=1, dtype=np.int64) + n * (1 + k) for k in tried])
    best = costs.argmin(axis=0)
    rows = np.arange(len(n))
    return costs[best, rows], tried[best, rows]


def _pack(values: np.ndarray, sizes: np.ndarray, at: np.ndarray, total: int) -> np.ndarray:
    """Bytes with each value (of at most 32 bits) at its bit position; positions ascend."""
    out = np.zeros(total // 4 + 3, np.uint64)
    word, shift = at >> 5, 64 - (at & 31) - sizes
    wide = values.astype(np.uint64) << shift.astype(np.uint64)
    heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
    if len(heads):
        out[word[heads]] += np.add.reduceat(wide >> np.uint64(32), heads)
        out[word[heads] + 1] += np.add.reduceat(wide & np.uint64(0xFFFFFFFF), heads)
    return out.astype(">u4").view(np.uint8)[:total]


def encode(data: np.ndarray, offs: np.ndarray, block: int = BLOCK) -> list[bytes]:
    """One stream for each span of unsigned 8-bit samples; spans are not empty."""
    sizes = np.diff(offs)
    count = -(-sizes // block)
    doc = np.repeat(np.arange(len(sizes)), count)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    n = np.minimum(block, sizes[doc] - number * block)
    at = offs[doc] + number * block
    inside = np.arange(block) < n[:, None]
    s = np.zeros((len(doc), block), np.int32)
    s[inside] = data[(at[:, None] + np.arange(block))[inside]].astype(np.int32) - 128

    # the candidates: the fixed predictor of the smallest residuals, and LPC of order 2
    fixed, residual, least, step = np.zeros(len(doc), np.int64), s.copy(), np.abs(s).sum(axis=1, dtype=np.int64), s
    for degree in range(1, 5):
        step = np.diff(step, axis=1, prepend=np.int32(0))
        left = np.where(inside & (np.arange(block) >= degree), step, 0)
        size = np.abs(left).sum(axis=1, dtype=np.int64)
        better = (size < least) & (n > degree)
        fixed[better], residual[better], least[better] = degree, left[better], size[better]
    f = s.astype(np.float32)
    r0, r1, r2 = (np.einsum("ij,ij->i", f[:, lag:], f[:, : block - lag]).astype(np.float64) for lag in range(3))
    det = np.where(r0 * r0 - r1 * r1 > 1e-6 * r0 * r0, r0 * r0 - r1 * r1, np.inf)
    coef = np.stack([r1 * (r0 - r2) / det, (r0 * r2 - r1 * r1) / det], axis=1)
    coef = np.clip(np.rint(coef * (1 << _SHIFT)), -(1 << (_PRECISION - 1)), (1 << (_PRECISION - 1)) - 1).astype(np.int32)
    guessed = s.copy()
    guessed[:, 2:] -= (coef[:, :1] * s[:, 1:-1] + coef[:, 1:] * s[:, :-2]) >> _SHIFT
    guessed[~inside] = 0
    u, guess = _zigzag(residual), _zigzag(guessed)
    guess[:, :2] = 0
    (cost, k), (cost2, k2) = _rice_cost(u, n - fixed), _rice_cost(guess, n - 2)
    costs = [cost + 18 + 8 * fixed, np.where(n > 2, cost2 + 18 + 16 + 9 + 2 * _PRECISION, 1 << 60), 8 * n + 8]
    kind = np.choose(np.stack(costs).argmin(axis=0), [fixed, np.full(len(n), _LPC), np.full(len(n), _VERBATIM)])
    lpc = kind == _LPC
    k = np.where(lpc, k2, k)
    u[lpc] = guess[lpc]
    kind[(u >> k[:, None]).max(axis=1) > 22] = _VERBATIM
    kind[((s == s[:, :1]) & inside).sum(axis=1) == n] = _CONSTANT
    order = np.select([kind == _LPC, kind < 0], [2, 0], kind)
    coded = kind >= 0

    # the values of each subframe and their sizes in bits, row by row
    head = 9  # type, warm-up (4), LPC (3), residual head
    vals = np.zeros((len(doc), head + block), np.int32)
    bits = np.zeros((len(doc), head + block), np.int32)
    vals[:, 0] = np.select([kind == _CONSTANT, kind == _VERBATIM, kind == _LPC], [0, 1 << 1, (32 + 1) << 1], (8 + order) << 1)
    bits[:, 0] = 8
    for j in range(4):
        warm = (order > j) | ((kind == _CONSTANT) & (j == 0))
        vals[warm, 1 + j], bits[warm, 1 + j] = s[warm, j] & 0xFF, 8
    lpc = kind == _LPC
    for j, (v, b) in enumerate((((_PRECISION - 1) << 5 | _SHIFT, 9), (coef[:, 0] & ((1 << _PRECISION) - 1), _PRECISION), (coef[:, 1] & ((1 << _PRECISION) - 1), _PRECISION))):
        vals[lpc, 5 + j], bits[lpc, 5 + j] = v[lpc] if isinstance(v, np.ndarray) else v, b
    vals[coded, 8], bits[coded, 8] = k[coded], 2 + 4 + 4  # Rice with 4-bit parameters, one partition
    rice = inside & coded[:, None] & (np.arange(block) >= order[:, None])
    body_v, body_b = vals[:, head:], bits[:, head:]
    kk = np.broadcast_to(k[:, None], u.shape)[rice]
    uu = u[rice]
    body_v[rice] = (1 << kk) | (uu & ((1 << kk) - 1))
    body_b[rice] = (uu >> kk) + 1 + kk
    plain = inside & (kind == _VERBATIM)[:, None]
    body_v[plain], body_b[plain] = s[plain] & 0xFF, 8

    heads = [bytes([0xFF, 0xF8, 0x70, 0x02]) + _number(int(j)) + struct.pack(">H", m - 1) for j, m in zip(number, n, strict=True)]
    head_size = np.array([len(x) for x in heads], np.int64)
    body_size = -(-bits.sum(axis=1) // 8)
    frame = head_size + 1 + body_size + 2
    start = np.cumsum(frame) - frame
    total = int(frame.sum())
    first = (start + head_size + 1) * 8
    place = first[:, None] + np.cumsum(bits, axis=1) - bits
    used = bits > 0
    buf = _pack(vals[used], bits[used], place[used], total)
    flat = np.frombuffer(b"".join(heads), np.uint8)
    where = np.repeat(start - (np.cumsum(head_size) - head_size), head_size) + np.arange(len(flat))
    buf[where] = flat
    buf[start + head_size] = _crc(buf, start, start + head_size, 8)
    end = start + frame - 2
    check = _crc(buf, start, end, 16)
    buf[end], buf[end + 1] = check >> 8, check & 0xFF

    out, bounds = [], np.concatenate([[0], np.cumsum(count)])
    signed = (data ^ 0x80).tobytes()
    for d in range(len(sizes)):
        lo, hi = bounds[d], bounds[d + 1]
        base = start[lo]
        frames = buf[base : start[hi - 1] + frame[hi - 1]].tobytes()
        widest = int(min(block, sizes[d]))
        info = struct.pack(">HH", max(16, widest), max(16, widest)) + int(frame[lo:hi].min()).to_bytes(3, "big") + int(frame[lo:hi].max()).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | int(sizes[d])).to_bytes(8, "big") + hashlib.md5(signed[offs[d] : offs[d + 1]]).digest()
        points = np.zeros(hi - lo, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]))
        points["sample"], points["offset"], points["n"] = number[lo:hi] * block, start[lo:hi] - base, n[lo:hi]
        table = points.tobytes()
        out.append(b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([0x83]) + len(table).to_bytes(3, "big") + table + frames)
    return out


# --- decoding ----------------------------------------------------------------------------------


class Stream:
    """Metadata of one stream."""

    def __init__(self, raw: bytes):
        if raw[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        at, last, self.points = 4, False, []
        while not last:
            last, kind, size = bool(raw[at] & 0x80), raw[at] & 0x7F, int.from_bytes(raw[at + 1 : at + 4], "big")
            body = raw[at + 4 : at + 4 + size]
            if kind == 0:
                packed = int.from_bytes(body[10:18], "big")
                self.rate, self.channels, self.bits, self.samples, self.md5 = packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1, body[18:34]
            elif kind == 3:
                self.points = [p for p in struct.iter_unpack(">QQH", body) if p[0] != (1 << 64) - 1]
            at += 4 + size
        if self.channels != 1 or self.bits > 16:
            raise ValueError("only mono streams of at most 16 bits a sample")
        self.frames_at = at

    @property
    def listed(self) -> bool:
        """Whether the seek table names every frame."""
        return bool(self.points) and self.points[0][0] == 0 and all(a[0] + a[2] == b[0] for a, b in zip(self.points, self.points[1:], strict=False)) and self.points[-1][0] + self.points[-1][2] == self.samples


_ZEROS = 16 - np.array([k.bit_length() for k in range(1 << 16)], np.int64)


class _Bits:
    """Bit access for many lanes: up to 56 bits anywhere."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate([data, np.zeros(16, np.uint8)]).astype(np.uint64)
        two = padded[:-1] << np.uint64(8) | padded[1:]
        four = two[:-2] << np.uint64(16) | two[2:]
        self.words = four[:-4] << np.uint64(32) | four[4:]

    def window(self, at: np.ndarray) -> np.ndarray:
        """The bits from each position on, at the top of 64."""
        return self.words[at >> 3] << (at & 7).astype(np.uint64)

    def read(self, at: np.ndarray, n) -> np.ndarray:
        return (self.window(at) >> np.uint64(8)).astype(np.int64) >> (56 - n)

    def unary(self, at: np.ndarray, window: np.ndarray) -> np.ndarray:
        """How many zeros come before the next one."""
        zeros = _ZEROS[window >> np.uint64(48)]
        far = np.flatnonzero(zeros == 16)
        more = far
        while len(more):
            step = _ZEROS[self.window(at[more] + zeros[more]) >> np.uint64(48)]
            zeros[more] += step
            more = more[step == 16]
            if len(more) and (at[more] + zeros[more] >= 8 * len(self.words)).any():
                raise ValueError("a frame is cut short")
        return zeros


def _signed(x: np.ndarray, n) -> np.ndarray:
    return x - ((x >> (n - 1) & 1) << n)


def decode_frames(data: np.ndarray, starts: np.ndarray, bps: int, largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(samples by lane and step, number of samples, end of each frame) of the frames at ``starts``."""
    lanes = len(starts)
    bits = _Bits(data)
    if (bits.read(starts * 8, 16) & 0xFFFE != 0xFFF8).any():
        raise ValueError("no frame where one was expected")
    size_code, rate_code = data[starts + 2] >> 4, data[starts + 2] & 15
    lead = data[starts + 4].astype(np.int64)
    wide = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [1, 2, 3, 4, 5, 6], 7)
    at = starts + 4 + wide
    n = np.select([size_code == 1, size_code < 6, size_code == 6, size_code == 7], [192, 144 << np.minimum(size_code, 6).astype(np.int64), data[at].astype(np.int64) + 1, bits.read(at * 8, 16) + 1], 1 << np.minimum(size_code, 15).astype(np.int64))
    at = at + np.select([size_code == 6, size_code == 7], [1, 2], 0) + np.select([rate_code == 12, rate_code > 12], [1, 2], 0)
    if (_crc(data, starts, at, 8) != data[at]).any():
        raise ValueError("a frame header does not match its CRC-8")
    if (n > largest).any():
        raise ValueError("a frame is larger than its stream allows")
    order_of = np.argsort(-n, kind="stable")  # lanes still at work are always the first ones
    n, pos = n[order_of], (at[order_of] + 1) * 8
    kind = bits.read(pos, 8) >> 1
    if (bits.read(pos, 8) & 0x81).any():
        raise ValueError("reserved bits or wasted bits are set")
    pos = pos + 8
    lpc, fixed = kind >= 32, (kind >= 8) & (kind < 13)
    constant, verbatim = kind == 0, kind == 1
    if not (lpc | fixed | constant | verbatim).all():
        raise ValueError("reserved subframe type")
    order = np.where(lpc, kind - 31, np.where(fixed, kind - 8, 0))
    out = np.zeros((int(n.max()) if lanes else 0, lanes), np.int64)
    for t in range(int(order.max()) if lanes else 0):
        mine = order > t
        out[t, mine] = _signed(bits.read(pos[mine], bps), bps)
        pos[mine] += bps
    if constant.any():
        out[:, constant] = _signed(bits.read(pos[constant], bps), bps)
        pos[constant] += bps
    for lane in np.flatnonzero(verbatim):
        where = pos[lane] + bps * np.arange(n[lane])
        out[: n[lane], lane] = _signed(bits.read(where, bps), bps)
        pos[lane] += bps * n[lane]
    deep = int(order.max()) if lanes else 0
    coef, shift = np.zeros((deep, lanes), np.int64), np.zeros(lanes, np.int64)
    if lpc.any():
        precision = bits.read(pos[lpc], 4) + 1
        shift[lpc] = bits.read(pos[lpc] + 4, 5)
        pos[lpc] += 9
        for j in range(deep):
            has = order[lpc] > j
            mine = np.flatnonzero(lpc)[has]
            coef[j, mine] = _signed(bits.read(pos[mine], precision[has]), precision[has])
            pos[mine] += precision[has]
    for k in np.unique(order[fixed]):
        coef[:k, fixed & (order == k)] = np.array(_FIXED[k], np.int64)[:, None]

    # residuals, one sample of each lane at a step
    work = np.flatnonzero(lpc | fixed)
    if len(work):
        p, m, o, c, sh = pos[work], n[work], order[work], coef[:, work], shift[work]
        width = np.where(bits.read(p, 2) == 1, 5, 4)
        parts = bits.read(p + 2, 4)
        p = p + 6
        span = m >> parts
        left = span - o  # samples to come in the present partition
        due = np.ones(len(work), bool)
        k, raw = np.zeros(len(work), np.int64), np.zeros(len(work), bool)
        s = np.zeros((int(m.max()), len(work)), np.int64)
        s[:deep] = out[:deep, work] if deep else 0
        low = int(o.min())
        for t in range(low, int(m.max())):
            a = int(np.searchsorted(-m, -t, "left"))
            late = o[:a] > t if t < deep else None
            fresh = due[:a] & (o[:a] <= t) if late is not None else due[:a]
            if fresh.any():
                f = np.flatnonzero(fresh)
                k[f] = bits.read(p[f], width[f])
                p[f] += width[f]
                raw[f] = k[f] == (1 << width[f]) - 1
                e = f[raw[f]]
                k[e] = bits.read(p[e], 5)
                p[e] += 5
                due[f] = False
            hold = p[:a].copy() if late is not None else None
            top = bits.window(p[:a])
            q = bits.unary(p[:a], top)
            one = p[:a] + q + 1
            near = q < 32
            if near.all():
                low_bits = (top << (q + 1).astype(np.uint64) >> np.uint64(8)).astype(np.int64) >> (56 - k[:a])
            else:
                low_bits = bits.read(one, k[:a])
            u = q << k[:a] | low_bits
            r = u >> 1 ^ -(u & 1)
            one += k[:a]
            if raw[:a].any():
                e = np.flatnonzero(raw[:a])
                r[e] = np.where(k[e] > 0, _signed(bits.read(p[e], k[e]), np.maximum(k[e], 1)), 0)
                one[e] = p[e] + k[e]
            if deep:
                guess = np.zeros(a, np.int64)
                for j in range(min(deep, t)):
                    guess += c[j, :a] * s[t - 1 - j, :a]
                r += guess >> sh[:a]
            p[:a] = one
            left[:a] -= 1
            if late is not None and late.any():
                p[:a][late] = hold[late]
                left[:a][late] += 1
                r[late] = s[t, :a][late]
            s[t, :a] = r
            done = left[:a] == 0
            if done.any():
                g = np.flatnonzero(done)
                due[g], left[g] = True, span[g]
        out[: len(s), work] = s
        pos[work] = p
    ends = np.empty(lanes, np.int64)
    ends[order_of] = -(-pos // 8) + 2
    sizes = np.empty(lanes, np.int64)
    sizes[order_of] = n
    back = np.empty_like(order_of)
    back[order_of] = np.arange(lanes)
    stored = bits.read((ends - 2) * 8, 16)
    if (_crc(data, starts, ends - 2, 16) != stored).any():
        raise ValueError("a frame does not match its CRC-16")
    return out[:, back].T, sizes, ends


def decode(streams: list[bytes]) -> list[tuple[np.ndarray, list[tuple[int, int, int, int, int]]]]:
    """(samples, blocks) of each stream; a block is (first sample, samples, byte offset of its frame,
    largest magnitude, sum of squares)."""
    infos = [Stream(x) for x in streams]
    data = np.frombuffer(b"".join(streams), np.uint8)
    base = np.concatenate([[0], np.cumsum([len(x) for x in streams])])
    listed = [i for i, x in enumerate(infos) if x.listed]
    found: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for bps in {infos[i].bits for i in listed}:
        mine = [i for i in listed if infos[i].bits == bps]
        starts = [base[i] + infos[i].frames_at + np.array([p[1] for p in infos[i].points], np.int64) for i in mine]
        samples, n, _ = decode_frames(data, np.concatenate(starts), bps, 1 << 16)
        at = 0
        for i, x in zip(mine, starts, strict=True):
            found[i] = samples[at : at + len(x)], n[at : at + len(x)], x - base[i]
            at += len(x)
    for i, info in enumerate(infos):
        if i not in found:  # frames follow each other: the end of one is the start of the next
            at, parts, starts = base[i] + info.frames_at, [], []
            while at < base[i + 1]:
                samples, n, ends = decode_frames(data, np.array([at]), info.bits, 1 << 16)
                parts.append(samples[0, : n[0]])
                starts.append(at - base[i])
                at = int(ends[0])
            n = np.array([len(x) for x in parts], np.int64)
            samples = np.zeros((len(parts), int(n.max()) if len(n) else 0), np.int64)
            for j, x in enumerate(parts):
                samples[j, : len(x)] = x
            found[i] = samples, n, np.array(starts, np.int64)
    out = []
    for i, info in enumerate(infos):
        samples, n, starts = found[i]
        pcm = samples[np.arange(samples.shape[1]) < n[:, None]]
        if len(pcm) != info.samples:
            raise ValueError("the stream has other samples than it says")
        raw = pcm.astype(np.int8) if info.bits <= 8 else pcm.astype("<i2")
        if info.md5 != bytes(16) and hashlib.md5(raw.tobytes()).digest() != info.md5:
            raise ValueError("the samples do not match the stream's MD5")
        first = np.cumsum(n) - n
        peak, energy = (f.reduceat(x, first) if len(n) else n for f, x in ((np.maximum, np.abs(pcm)), (np.add, pcm * pcm)))
        out.append((pcm, list(zip(first.tolist(), n.tolist(), starts.tolist(), peak.tolist(), energy.tolist(), strict=True))))
    return out


def read_samples(stream: bytes, first: int, count: int) -> np.ndarray:
    """``count`` samples from ``first`` on, from the frames that the seek table names for them."""
    info = Stream(stream)
    if not info.listed:
        return decode([stream])[0][0][first : first + count]
    points = [p for p in info.points if p[0] < first + count and p[0] + p[2] > first]
    if not points:
        return np.zeros(0, np.int64)
    samples, n, _ = decode_frames(np.frombuffer(stream, np.uint8), info.frames_at + np.array([p[1] for p in points], np.int64), info.bits, 1 << 16)
    return np.concatenate([x[:k] for x, k in zip(samples, n, strict=True)])[first - points[0][0] :][:count]


# --- Spark -------------------------------------------------------------------------------------


def encode_column(rows: DataFrame, payload: str = "payload", media: str = "media") -> DataFrame:
    """``rows`` with the stream of each binary ``payload`` of unsigned 8-bit samples; a null or empty
    payload has a null stream. A column of the input named like ``media`` is replaced."""
    rows = rows.drop(media)
    names = [f.name for f in rows.schema.fields]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, payload, STEP_BYTES):
                data, offs = string_parts(b.column(names.index(payload)))
                full = np.flatnonzero(np.diff(offs))
                made: list[bytes | None] = [None] * b.num_rows
                if len(full):
                    for i, x in zip(full, encode(data, np.append(offs[full], offs[-1])), strict=True):
                        made[i] = x
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.binary())], [*names, media])

    return rows.mapInArrow(run, f"{ddl}, `{media}` binary")


def decode_column(rows: DataFrame, media: str = "media") -> DataFrame:
    """``rows`` with ``pcm`` (unsigned 8-bit samples of the stream in ``media``) and ``blocks``, which
    seek into it: (first_sample, n_samples, frame_offset, peak, energy) of each frame. A null stream
    has null samples. Columns of the input called pcm or blocks are replaced."""
    rows = rows.drop("pcm", "blocks")
    names = [f.name for f in rows.schema.fields]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    fields = ("first_sample", "n_samples", "frame_offset", "peak", "energy")
    kind = pa.list_(pa.struct([(k, pa.int64()) for k in fields]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, media, STEP_BYTES):
                column = b.column(names.index(media)).to_pylist()
                full = [i for i, x in enumerate(column) if x is not None]
                pcm: list[bytes | None] = [None] * b.num_rows
                blocks: list[list | None] = [None] * b.num_rows
                for i, (samples, parts) in zip(full, decode([column[i] for i in full]), strict=True):
                    pcm[i] = (samples + 128).astype(np.uint8).tobytes()
                    blocks[i] = [dict(zip(fields, x, strict=True)) for x in parts]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pcm, pa.binary()), pa.array(blocks, kind)], [*names, "pcm", "blocks"])

    return rows.mapInArrow(run, f"{ddl}, pcm binary, blocks array<struct<{', '.join(f'{k}: bigint' for k in fields)}>>")
