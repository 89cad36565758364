"""Operator 5: texts as 8-bit mono FLAC streams, written and read back.

A payload (the text's bytes, and zero bytes up to a positive multiple of 64) is stored
as signed 8-bit samples in FLAC (RFC 9639): STREAMINFO with the samples' MD5, a SEEKTABLE
with a point for every frame, and frames of up to ``BLOCK`` samples. A frame has the
fixed linear predictor of order 0 to 4 and the Rice parameter that make it smallest.

The decoder reads metadata, then frames, whose header CRC-8 and frame CRC-16 it verifies,
Rice residuals, and the predictor. Samples are read from any offset by the seek table.
Frames of many documents are decoded in step, one sample of each at a time, so Python's
cost is shared by thousands of frames. Streams of other encoders (1 to 8 channels of 4 to
32 bits, constant, verbatim, fixed and linear predictors, partitioned and escaped Rice
codes, decorrelated stereo, no seek table) are decoded frame after frame.

``store`` writes the streams into a folder, ``read_back`` decodes what a table of them holds,
``write_pcm`` turns stored streams into PCM blocks (rows of document, block, first sample
and samples), ``seek`` reads some samples without decoding the frames before them.

Cases: ids of ``write_pcm`` are numbers (other ids raise); null and empty texts are 64 zero bytes; equal texts give equal streams; repeated
rows are stored each; a text of any length is cut into frames, and decoding works on
``STEP_FRAMES`` of them at a time; a damaged stream raises ValueError; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blobs, shared_dir, ship, slices, table, task, with_columns

BLOCK, RATE, STEP_FRAMES, STEP_TEXT = 1024, 44_100, 4096, 2_000_000
MAX_RICE = 9


def _crc_table(bits: int, polynomial: int) -> np.ndarray:
    out = np.zeros(256, np.uint16)
    for i in range(256):
        x = i << (bits - 8)
        for _ in range(8):
            x = (x << 1 ^ polynomial if x >> (bits - 1) else x << 1) & ((1 << bits) - 1)
        out[i] = x
    return out


_CRC8, _CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)


def _crc16(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-16 of many spans of bytes, in step."""
    crc = np.zeros(len(starts), np.uint16)
    order = np.argsort(-lengths, kind="stable")
    at, left = starts[order], lengths[order]
    state = np.zeros(len(starts), np.uint16)
    live = len(order)
    for i in range(int(left[0]) if len(left) else 0):
        while live and left[live - 1] <= i:
            live -= 1
        s = state[:live]
        state[:live] = (s << np.uint16(8)) ^ _CRC16[(s >> np.uint16(8)) ^ data[at[:live] + i]]
    crc[order] = state
    return crc


def _crc8(data: bytes) -> int:
    x = 0
    for b in data:
        x = int(_CRC8[x ^ b])
    return x


_CRC16_LIST = _CRC16.tolist()


def _crc16_of(data: bytes) -> int:
    """CRC-16 of one span."""
    x = 0
    for b in data:
        x = x << 8 & 0xFFFF ^ _CRC16_LIST[x >> 8 ^ b]
    return x


def _number(n: int) -> bytes:
    """A frame number in the extended UTF-8 form."""
    if n < 0x80:
        return bytes([n])
    tail = []
    limit = 0x20
    while True:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        if n < limit:
            return bytes([0xFF & ~(2 * limit - 1) | n, *reversed(tail)])
        limit >>= 1


def _header(number: int, samples: int) -> bytes:
    """A frame header: fixed block size, 44.1 kHz, mono, 8 bits."""
    size = b"" if samples == BLOCK else (samples - 1).to_bytes(2, "big")
    code = 0b1010 if samples == BLOCK else 0b0111
    head = bytes([0xFF, 0xF8, code << 4 | 0b1001, 0b0000_001_0]) + _number(number) + size
    return head + bytes([_crc8(head)])


_headers: dict[tuple[int, int], bytes] = {}


def _residuals(x: np.ndarray) -> list[np.ndarray]:
    """Rows of samples after the fixed predictors of order 0 to 4; the first ones of a row are its warm-up samples."""
    out = [x]
    for k in range(1, 5):
        d = out[-1].copy()
        d[:, k:] = out[-1][:, k:] - out[-1][:, k - 1 : -1]
        out.append(d)
    return out


def _encode_frames(samples: np.ndarray, numbers: list[int]) -> list[bytes]:
    """Frames of the rows of samples (equal counts), coded together."""
    rows, n = samples.shape
    if not rows:
        return []
    # The order with the least sum of folded residuals; for it, the best of three parameters about the mean's logarithm.
    orders = [k for k in range(5) if k < n]
    folded = [(r << 1) ^ (r >> 15) for r, _ in zip(_residuals(samples.astype(np.int16)), orders, strict=False)]
    sums = np.array([u[:, k:].sum(1, dtype=np.int64) + 8 * k for k, u in zip(orders, folded, strict=True)])
    order = sums.argmin(0)
    choice = np.zeros(rows, np.int64)
    for k in np.unique(order):
        at = np.flatnonzero(order == k)
        u = folded[k][at][:, k:]
        middle = np.log2(np.maximum(u.mean(1), 1)).astype(np.int64)
        tried = []
        for step in (-1, 0, 1):
            p = np.clip(middle + step, 0, MAX_RICE)
            tried.append((u >> p[:, None].astype(np.int16)).sum(1, dtype=np.int64) + (n - k) * (1 + p))
        choice[at] = k * 16 + np.clip(middle + np.argmin(tried, 0) - 1, 0, MAX_RICE)
    out: list[bytes] = [b""] * rows
    for c in np.unique(choice):
        at = np.flatnonzero(choice == c)
        k, p = int(c) >> 4, int(c) & 15
        u = folded[k][at][:, k:].astype(np.int32)
        q = u >> p
        width = q + (1 + p)
        ends = np.cumsum(width, axis=1, dtype=np.int32)
        # subframe header, warm-up samples, coding method, partition order, Rice parameter
        lead = 8 + 8 * k + 2 + 4 + 4
        total = lead + (ends[:, -1] if n > k else np.zeros(len(at), np.int64))
        size = -(-total // 8)
        base = np.concatenate([[0], np.cumsum(size)])
        bits = np.zeros(int(base[-1]) * 8, np.uint8)
        start = base[:-1] * 8
        fixed = np.array([int(b) for b in f"0{8 + k:06b}0"], np.uint8)
        bits[start[:, None] + np.arange(8)] = fixed
        for j in range(k):
            warm = samples[at, j].astype(np.uint8)
            bits[start[:, None] + 8 + 8 * j + np.arange(8)] = (warm[:, None] >> np.arange(7, -1, -1)) & 1
        bits[start[:, None] + 8 + 8 * k + np.arange(10)] = np.array([int(b) for b in f"000000{p:04b}"], np.uint8)
        if n > k:
            one = (start[:, None] + (lead - 1 - p)) + ends
            bits[one] = 1
            for j in range(p):
                one += 1
                bits[one] = (u >> (p - 1 - j)) & 1
        data = np.packbits(bits)
        heads = []
        for i in at.tolist():
            key = (numbers[i], n)
            if key not in _headers:
                if len(_headers) > 100_000:
                    _headers.clear()
                _headers[key] = _header(*key)
            heads.append(_headers[key])
        for i, h, a, b in zip(at.tolist(), heads, base[:-1].tolist(), base[1:].tolist(), strict=True):
            out[i] = h + data[a:b].tobytes()
    lengths = np.array([len(x) for x in out])
    crc = _crc16(np.frombuffer(b"".join(out), np.uint8), np.cumsum(lengths) - lengths, lengths)
    return [x + c.to_bytes(2, "big") for x, c in zip(out, crc.tolist(), strict=True)]


def payload(text: bytes | None) -> bytes:
    text = text or b""
    return text + bytes(-len(text) % 64 or (0 if text else 64))


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload."""
    groups: dict[int, list[tuple[int, int, bytes]]] = {}
    for i, x in enumerate(payloads):
        for k, at in enumerate(range(0, len(x), BLOCK)):
            part = x[at : at + BLOCK]
            groups.setdefault(len(part), []).append((i, k, part))
    frames: list[dict[int, bytes]] = [{} for _ in payloads]
    for n, parts in groups.items():
        for at in range(0, len(parts), STEP_FRAMES):
            some = parts[at : at + STEP_FRAMES]
            coded = _encode_frames(np.frombuffer(b"".join(x for *_, x in some), np.int8).reshape(len(some), n), [k for _, k, _ in some])
            for (i, k, _), x in zip(some, coded, strict=True):
                frames[i][k] = x
    return [_stream(x, [own[k] for k in range(len(own))]) for x, own in zip(payloads, frames, strict=True)]


def _stream(data: bytes, frames: list[bytes]) -> bytes:
    sizes = [len(x) for x in frames]
    # At least 16 samples a block; with one block, it may be shorter than the rest would be.
    info = BLOCK.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
    info += (RATE << 44 | 0 << 41 | 7 << 36 | len(data)).to_bytes(8, "big") + hashlib.md5(data).digest()
    points, at = [], 0
    for k, n in enumerate(sizes):
        points.append((k * BLOCK).to_bytes(8, "big") + at.to_bytes(8, "big") + min(BLOCK, len(data) - k * BLOCK).to_bytes(2, "big"))
        at += n
    # A metadata block holds less than 16 MiB; of very long streams every 2nd, 4th, ... frame has a point.
    while len(points) * 18 >= 1 << 24:
        points = points[::2]
    table = b"".join(points)
    return b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + b"".join(frames)


class Layout(NamedTuple):
    """What the metadata blocks say; ``first`` is the place of the first frame, ``points`` are (sample, place from there, samples)."""

    block: int
    total: int
    digest: bytes
    channels: int
    bits: int
    points: list[tuple[int, int, int]]
    first: int

    @property
    def width(self) -> int:
        """Bytes of one sample of all channels in PCM."""
        return self.channels * -(-self.bits // 8)


def layout(stream: bytes) -> Layout:
    """The metadata of a stream; blocks other than STREAMINFO and SEEKTABLE are passed over."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, info, points = 4, False, b"", []
    while not last:
        if at + 4 > len(stream):
            raise ValueError("metadata without an end")
        kind, n = stream[at], int.from_bytes(stream[at + 1 : at + 4], "big")
        last, body = bool(kind & 0x80), stream[at + 4 : at + 4 + n]
        if kind & 0x7F == 0:
            info = body
        elif kind & 0x7F == 3:
            points = [tuple(int.from_bytes(body[i + a : i + b], "big") for a, b in ((0, 8), (8, 16), (16, 18))) for i in range(0, n, 18)]
        at += 4 + n
    if len(info) < 34:
        raise ValueError("no STREAMINFO")
    packed = int.from_bytes(info[10:18], "big")
    points = [x for x in points if x[0] != (1 << 64) - 1]  # placeholders
    return Layout(int.from_bytes(info[2:4], "big"), packed & ((1 << 36) - 1), info[18:34], (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, points, at)


def _parse_header(data: bytes, at: int) -> tuple[int, int, int]:
    """Frame number, samples and header length, its CRC-8 verified."""
    if data[at : at + 2] != b"\xff\xf8" or data[at + 3] != 0b10:
        raise ValueError(f"no frame at byte {at}")
    lead = data[at + 4]
    more = 0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1
    number = lead if not more else lead & (0x3F >> more)
    for x in data[at + 5 : at + 5 + more]:
        number = number << 6 | x & 0x3F
    end, code = at + 5 + more, data[at + 2] >> 4
    if code == 0b0111:
        samples, end = int.from_bytes(data[end : end + 2], "big") + 1, end + 2
    elif code == 0b1010:
        samples = 1024
    else:
        raise ValueError("block size code")
    if _headers.get((number, samples)) != data[at : end + 1] and _crc8(data[at:end]) != data[end]:
        raise ValueError("header checksum")
    return number, samples, end + 1 - at


def _long_code(data: np.ndarray, place: int, p: int) -> tuple[int, int]:
    """Quotient and remainder of a Rice code of any length."""
    n = 16
    while True:
        bits = int.from_bytes(data[place >> 3 : (place >> 3) + n].tobytes(), "big") & ((1 << (8 * n - (place & 7))) - 1)
        q = 8 * n - (place & 7) - bits.bit_length()
        rest = bits.bit_length() - 1 - p
        if bits and rest >= 0:
            return q, bits >> rest & ((1 << p) - 1)
        if (place >> 3) + n > len(data):
            raise ValueError("a code without an end")
        n *= 4


def _decode_frames(frames: list[bytes]) -> list[np.ndarray]:
    """The samples of each frame; all frames are read in step."""
    if not frames:
        return []
    heads = [_parse_header(x, 0) for x in frames]
    sizes = np.array([len(x) for x in frames])
    whole = b"".join(frames) + bytes(16)
    data = np.frombuffer(whole, np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    crc = data[starts + sizes - 2].astype(np.uint16) << np.uint16(8) | data[starts + sizes - 1]
    if (crc != _crc16(data, starts, sizes - 2)).any():
        raise ValueError("frame checksum")
    samples, at = np.array([h[1] for h in heads]), starts + np.array([h[2] for h in heads])
    kind = data[at]
    order = (kind.astype(np.int64) >> 1) - 8
    if ((order < 0) | (order > 4) | (kind & 0x81 != 0)).any():
        raise ValueError("subframe kind")
    words = np.zeros(len(data) - 3, np.uint32)  # 32 bits from each byte on
    for i in range(4):
        words = words << np.uint32(8) | data[i : len(data) - 3 + i]
    turn = np.argsort(-samples, kind="stable")
    samples, at, order = samples[turn], at[turn], order[turn]
    place = at * 8 + 8
    out = np.zeros((len(frames), int(samples[0])), np.int32)
    for j in range(int(order.max(initial=0))):
        k = order > j
        out[k, j] = data[(place[k] >> 3) + j].astype(np.int8)
    place = place + 8 * order
    head = (words[place >> 3] >> (np.uint32(22) - (place & 7).astype(np.uint32))) & np.uint32(0x3FF)
    if (head >> np.uint32(4) != 0).any() or (head & np.uint32(15) > 9).any():
        raise ValueError("residual coding")
    p = (head & np.uint32(15)).astype(np.int64)
    place = place + 10
    back = (32 - p).astype(np.uint32)
    low = (1 << p) - 1
    live = len(frames)
    for i in range(int(samples[0])):
        while live and samples[live - 1] <= i:
            live -= 1
        here, param = place[:live], p[:live]
        window = words[here >> 3] << (here & 7).astype(np.uint32)  # 25 bits of it are the stream's at least
        q = 32 - np.frexp(window.astype(np.float64))[1].astype(np.int64)
        r = (window << (q + 1).clip(0, 31).astype(np.uint32)) >> back[:live] & low[:live]
        if (q + param).max(initial=0) > 24:  # a code that is longer than the window
            for x in np.flatnonzero(q + param > 24).tolist():
                q[x], r[x] = _long_code(data, int(here[x]), int(param[x]))
        u = (q << param) | r
        value = (u >> 1) ^ -(u & 1)
        after = here + q + 1 + param
        if i < 4:
            k = order[:live] <= i
            place[:live] = np.where(k, after, here)
            out[:live, i] = np.where(k, value, out[:live, i])
        else:
            place[:live] = after
            out[:live, i] = value
    # Predictors: order k is the sum k times over, from the differences of the warm-up samples.
    for k in range(1, 5):
        own = np.flatnonzero(order == k)
        if len(own):
            x = out[own]
            for j in range(1, k):  # warm-up samples to differences
                x[:, j:k] = np.diff(x[:, j - 1 : k], axis=1)
            for j in range(k - 1, -1, -1):
                x[:, j:] = np.cumsum(x[:, j:], axis=1)
            out[own] = x
    result: list[np.ndarray] = [np.zeros(0, np.int8)] * len(frames)
    for t, n, x in zip(turn.tolist(), samples.tolist(), out.astype(np.int8), strict=True):
        result[t] = x[:n]
    return result


class _Bits:
    """A reader of bits, most significant first; reading past the end raises ValueError."""

    def __init__(self, data: bytes, at: int):
        self.data, self.place = data, 8 * at

    def take(self, n: int) -> int:
        a, stop = self.place, self.place + n
        if stop > 8 * len(self.data):
            raise ValueError("the stream ends within a frame")
        self.place = stop
        return int.from_bytes(self.data[a >> 3 : (stop + 7) >> 3], "big") >> (-stop & 7) & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        x = self.take(n)
        return x - (x >> (n - 1) << n) if n else 0

    def unary(self) -> int:
        """Zeros before the next one, which is read too."""
        a = self.place
        while True:
            part = self.data[self.place >> 3 : (self.place >> 3) + 16]
            left = 8 * len(part) - (self.place & 7)
            x = int.from_bytes(part, "big") & ((1 << max(left, 0)) - 1)
            if x:
                zeros = self.place - a + left - x.bit_length()
                self.place = a + zeros + 1
                return zeros
            if len(part) < 16:
                raise ValueError("a code without an end")
            self.place += left


def _residual(bits: _Bits, samples: int, order: int) -> list[int]:
    """Rice partitions of either coding method, escaped ones too."""
    method = bits.take(2)
    if method > 1:
        raise ValueError("residual coding")
    width, parts = 4 + method, 1 << bits.take(4)
    if samples % parts or samples // parts < order:
        raise ValueError("residual partitions")
    out: list[int] = []
    for k in range(parts):
        n, p = samples // parts - (order if k == 0 else 0), bits.take(width)
        if p == (1 << width) - 1:
            raw = bits.take(5)
            out += [bits.signed(raw) for _ in range(n)]
            continue
        for _ in range(n):
            u = bits.unary() << p
            u |= bits.take(p)
            out.append(u >> 1 ^ -(u & 1))
    return out


#: Coefficients of the fixed predictors of order 0 to 4.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _subframe(bits: _Bits, samples: int, size: int) -> np.ndarray:
    """One channel of a frame: constant, verbatim, a fixed or a linear predictor, with wasted bits."""
    if bits.take(1):
        raise ValueError("subframe padding")
    kind = bits.take(6)
    wasted = bits.unary() + 1 if bits.take(1) else 0
    size -= wasted
    if size <= 0:
        raise ValueError("subframe size")
    if kind == 0:
        out = [bits.signed(size)] * samples
    elif kind == 1:
        out = [bits.signed(size) for _ in range(samples)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        if order > samples:
            raise ValueError("predictor order")
        out = [bits.signed(size) for _ in range(order)]
        if kind < 32:
            weights, shift = FIXED[order], 0
        else:
            precision, shift = bits.take(4) + 1, bits.signed(5)
            if precision == 16 or shift < 0:
                raise ValueError("predictor precision")
            weights = tuple(bits.signed(precision) for _ in range(order))
        rest = _residual(bits, samples, order)
        if not order:
            out = rest
        for i, e in enumerate(rest if order else (), order):
            out.append(e + (sum(w * out[i - 1 - j] for j, w in enumerate(weights)) >> shift))
    else:
        raise ValueError("subframe kind")
    return np.array(out, np.int64) << wasted


def _any_header(data: bytes, at: int, own: Layout) -> tuple[int, int, int, int, int]:
    """First sample, samples, channel code, bits and header length of any frame, its CRC-8 verified."""
    if len(data) < at + 6 or data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
        raise ValueError(f"no frame at byte {at}")
    size, rate, channels, code = data[at + 2] >> 4, data[at + 2] & 15, data[at + 3] >> 4, data[at + 3] >> 1 & 7
    lead = data[at + 4]
    more = 0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1
    number = lead if not more else lead & (0x3F >> more)
    for x in data[at + 5 : at + 5 + more]:
        number = number << 6 | x & 0x3F
    end = at + 5 + more
    if size in (6, 7):
        samples, end = int.from_bytes(data[end : end + size - 5], "big") + 1, end + size - 5
    elif size == 0:
        raise ValueError("block size code")
    else:
        samples = 192 if size == 1 else 576 << (size - 2) if size < 6 else 256 << (size - 8)
    end += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    bits = {0: own.bits, 1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}.get(code)
    if channels > 10 or bits is None or end >= len(data) or _crc8(data[at:end]) != data[end]:
        raise ValueError("header checksum")
    return number if data[at + 1] & 1 else number * own.block, samples, channels, bits, end + 1 - at


def _any_frame(data: bytes, at: int, own: Layout) -> tuple[int, np.ndarray, int]:
    """First sample, samples (a row each, a column for each channel) and end of the frame at a place."""
    first, samples, code, size, head = _any_header(data, at, own)
    bits = _Bits(data, at + head)
    side = {8: 1, 9: 0, 10: 1}.get(code)
    parts = [_subframe(bits, samples, size + (side == c)) for c in range(2 if code >= 8 else code + 1)]
    end = (bits.place + 7) >> 3
    if end + 2 > len(data) or _crc16_of(data[at:end]) != int.from_bytes(data[end : end + 2], "big"):
        raise ValueError("frame checksum")
    if code == 8:
        parts[1] = parts[0] - parts[1]
    elif code == 9:
        parts[0] = parts[1] + parts[0]
    elif code == 10:
        middle = parts[0] << 1 | parts[1] & 1
        parts = [(middle + parts[1]) >> 1, (middle - parts[1]) >> 1]
    return first, np.stack(parts, 1), end + 2


def _pcm(samples: np.ndarray, bits: int) -> bytes:
    """Signed little-endian PCM, channels interleaved."""
    width = -(-bits // 8)
    return samples.astype("<i8").reshape(-1, 1).view(np.uint8)[:, :width].tobytes()


def _walk(stream: bytes, own: Layout, at: int) -> Iterator[tuple[int, bytes]]:
    """First sample and PCM of each frame from a place on, each frame found by the end of the one before."""
    while at < len(stream):
        first, samples, at = _any_frame(stream, at, own)
        yield first, _pcm(samples, own.bits)


def _cut(stream: bytes) -> tuple[Layout, list[bytes]] | None:
    """Layout and frames of a stream that has the form ``encode`` gives, where frames lie between seek points; of others None."""
    own = layout(stream)
    if (own.block, own.channels, own.bits) != (BLOCK, 1, 8) or len(own.points) != -(-own.total // BLOCK):
        return None
    edges = [own.first + x[1] for x in own.points] + [len(stream)]
    return own, [stream[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _checked(own: Layout, data: bytes) -> bytes:
    if own.total and len(data) != own.total * own.width or any(own.digest) and hashlib.md5(data).digest() != own.digest:
        raise ValueError("samples don't match the stream's MD5")
    return data


def decode(streams: list[bytes]) -> list[bytes]:
    """The PCM of each stream, with frame checksums and the samples' MD5 verified.

    Frames of this module's form are decoded in step; if that fails, and for streams of
    other forms, frame after frame.
    """
    parts = [_cut(x) for x in streams]
    flat = [f for x in parts if x for f in x[1]]
    samples: list[np.ndarray] = []
    try:
        for at in range(0, len(flat), STEP_FRAMES):
            samples += _decode_frames(flat[at : at + STEP_FRAMES])
    except (ValueError, IndexError):
        parts = [None] * len(streams)
    out, at = [], 0
    for stream, x in zip(streams, parts, strict=True):
        if x is None:
            own = layout(stream)
            out.append(_checked(own, b"".join(pcm for _, pcm in _walk(stream, own, own.first))))
        else:
            out.append(_checked(x[0], b"".join(s.tobytes() for s in samples[at : at + len(x[1])])))
            at += len(x[1])
    return out


def seek(stream: bytes, first: int, count: int) -> bytes:
    """PCM of samples from an offset, decoding only from the last seek point before them on."""
    own = layout(stream)
    stop = min(own.total, first + count) if own.total else first + count
    if first >= stop:
        return b""
    at = max((x[1] for x in own.points if x[0] <= first), default=0)
    out = []
    for start, pcm in _walk(stream, own, own.first + at):
        if start >= stop:
            break
        out.append(pcm[max(first - start, 0) * own.width : (stop - start) * own.width])
    return b"".join(out)


def feature(data: bytes) -> str:
    """Samples, peak, mean of squares and sign changes of decoded samples."""
    x = np.frombuffer(data, np.int8).astype(np.int64)
    return f"samples={len(x)};peak={int(np.abs(x).max())};power={int((x * x).sum()) // len(x)};crossings={int((x[1:] >= 0).__xor__(x[:-1] >= 0).sum())}"


def streams(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (all by default) with _tw_bytes, the text's length, and _tw_media, its stream."""
    keep = keep if keep is not None else docs.columns
    schema = with_columns(docs.select(*keep).schema, "_tw_bytes long, _tw_media binary")

    @task("flac")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col, STEP_TEXT):
                texts = blobs(batch.column(text_col))
                own = [pa.array([len(x or b"") for x in texts], pa.int64()), pa.array(encode([payload(x) for x in texts]), pa.binary())]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *own], names=schema.names)

    ship(docs.sparkSession)
    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(run, schema)


def read_back(stored: DataFrame, media: bool = True) -> DataFrame:
    """What the streams in _tw_media hold: the payload's length, hash and last checksum, the stream's length and hash, and a feature of the samples; with ``media`` the stream too."""
    keep = [c for c in stored.columns if media or c != "_tw_media"]
    schema = with_columns(stored.select(*keep).schema, "_tw_payload_bytes long, _tw_payload_sha256 string, _tw_tail_crc32 long, _tw_media_bytes long, _tw_media_sha256 string, _tw_feature string")

    @task("flac")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_tw_media", STEP_TEXT):
                found = blobs(batch.column("_tw_media"))
                back = decode(found)
                own = [
                    pa.array([len(x) for x in back], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in back]),
                    pa.array([zlib.crc32(x[-64:]) for x in back], pa.int64()),
                    pa.array([len(x) for x in found], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in found]),
                    pa.array([feature(x) for x in back]),
                ]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *own], names=schema.names)

    ship(stored.sparkSession)
    return stored.mapInArrow(run, schema)


def store(docs: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Write the streams as Parquet into ``path``; the table of them."""
    made = streams(docs, text_col, keep)
    made.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(made.schema).parquet(path)


def write_pcm(stored: DataFrame, path: str, id_col: str = "doc_id", media_col: str = "_tw_media") -> None:
    """Decode streams and write PCM blocks as Parquet: id, block, first_sample, pcm."""

    @task("flac")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, media_col, STEP_TEXT):
                rows, found = [], blobs(batch.column(media_col))
                for key, stream, data in zip(batch.column(id_col).to_pylist(), found, decode(found), strict=True):
                    width = layout(stream).width
                    rows += [(key, k, k * BLOCK, data[at : at + BLOCK * width]) for k, at in enumerate(range(0, len(data), BLOCK * width))]
                columns = [[r[i] for r in rows] for i in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.binary())], names=["id", "block", "first_sample", "pcm"])

    ship(stored.sparkSession)
    stored.select(F.col(id_col).cast("long").alias(id_col), media_col).mapInArrow(run, "id long, block long, first_sample long, pcm binary").write.mode("overwrite").parquet(path)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = store(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/flac-{uuid.uuid4().hex}", keep=["doc_id"])
    return read_back(stored, media=False).toDF("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
