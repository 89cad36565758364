"""Streams of other encoders: every kind of subframe, written bit by bit here and decoded there."""

import hashlib
import random

import pytest

from tidewater.llm import flac

RNG = random.Random(5)


class Out:
    """Bits, most significant first."""

    def __init__(self):
        self.text = []

    def put(self, value, n):
        self.text.append(format(value & ((1 << n) - 1), f"0{n}b") if n else "")
        return self

    def bytes(self):
        text = "".join(self.text)
        text += "0" * (-len(text) % 8)
        return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8))


def crc(data, bits, polynomial):
    x = 0
    for b in data:
        x ^= b << (bits - 8)
        for _ in range(8):
            x = (x << 1 ^ polynomial if x >> (bits - 1) else x << 1) & ((1 << bits) - 1)
    return x


def rice(out, residuals, order, parts, method, parameters):
    n = (len(residuals) + order) // parts
    out.put(method, 2).put(parts.bit_length() - 1, 4)
    at = 0
    for k, p in enumerate(parameters):
        some = residuals[at : at + n - (order if k == 0 else 0)]
        at += len(some)
        if isinstance(p, tuple):  # escaped: raw bits of a width
            out.put((1 << (4 + method)) - 1, 4 + method).put(p[0], 5)
            for e in some:
                out.put(e, p[0])
            continue
        out.put(p, 4 + method)
        for e in some:
            u = e << 1 if e >= 0 else -e * 2 - 1
            out.put(1, (u >> p) + 1).put(u, p)


def subframe(out, x, size, kind, parts=1, method=0, parameters=(3,), weights=(), shift=0, wasted=0):
    codes = {"constant": 0, "verbatim": 1, "fixed": 8 + len(weights), "lpc": 31 + len(weights)}
    out.put(0, 1).put(codes[kind], 6).put(bool(wasted), 1)
    if wasted:
        out.put(1, wasted)
    size, x = size - wasted, [v >> wasted for v in x]
    if kind in ("constant", "verbatim"):
        for v in x[:1] if kind == "constant" else x:
            out.put(v, size)
        return
    order = len(weights)
    for v in x[:order]:
        out.put(v, size)
    if kind == "lpc":
        out.put(11, 4).put(shift, 5)
        for w in weights:
            out.put(w, 12)
    rice(out, [x[i] - (sum(w * x[i - 1 - j] for j, w in enumerate(weights)) >> shift) for i in range(order, len(x))], order, parts, method, parameters)


def frame(number, n, channel_code, size, subframes):
    head = Out().put(0b1111_1111_1111_1000, 16).put(7, 4).put(9, 4).put(channel_code, 4).put({8: 1, 16: 4, 24: 6}[size], 3).put(0, 1).put(number, 8).put(n - 1, 16).bytes()
    head += bytes([crc(head, 8, 0x07)])
    out = Out()
    for x, bits, kind, more in subframes:
        subframe(out, x, bits, kind, **more)
    body = head + out.bytes()
    return body + crc(body, 16, 0x8005).to_bytes(2, "big")


def stream(frames, pcm, block, channels, size, total, extra=True):
    info = block.to_bytes(2, "big") * 2 + bytes(6) + (44_100 << 44 | (channels - 1) << 41 | (size - 1) << 36 | total).to_bytes(8, "big") + hashlib.md5(pcm).digest()
    comment = b"\x84\x00\x00\x08" + bytes(8) if extra else b""
    return b"fLaC" + (b"\x00" if extra else b"\x80") + (34).to_bytes(3, "big") + info + comment + b"".join(frames)


def walk(n, top):
    x, out = 0, []
    for _ in range(n):
        x = max(-top, min(top - 1, x + RNG.randint(-9, 9)))
        out.append(x)
    return out


def pcm(channels, width):
    return b"".join(v.to_bytes(width, "little", signed=True) for row in zip(*channels, strict=True) for v in row)


KINDS = [
    ("constant", {}),
    ("verbatim", {}),
    ("fixed", {"weights": (), "parts": 4, "parameters": (0, 2, 5, (12,))}),
    ("fixed", {"weights": (2, -1), "parts": 2, "parameters": ((12,), 1)}),
    ("fixed", {"weights": (4, -6, 4, -1), "method": 1, "parameters": (4,)}),
    ("lpc", {"weights": (1800, -700, 150), "shift": 10, "parts": 8, "parameters": (2, 3, 4, 5, 2, (16,), 1, 3)}),
    ("lpc", {"weights": tuple(range(-16, 16)), "shift": 4, "method": 1, "parts": 2, "parameters": (6, (20,))}),
    ("verbatim", {"wasted": 2}),
    ("lpc", {"weights": (900,), "shift": 9, "wasted": 3, "parameters": (4,)}),
]


@pytest.mark.parametrize("size", [8, 16, 24])
def test_mono_of_every_kind(size):
    block, frames, whole = 192, [], []
    for k, (kind, more) in enumerate(KINDS):
        x = [5] * block if kind == "constant" else [v >> more.get("wasted", 0) << more.get("wasted", 0) for v in walk(block, 100)]
        frames.append(frame(k, block, 0, size, [(x, size, kind, more)]))
        whole += x
    data = pcm([whole], size // 8)
    made = stream(frames, data, block, 1, size, len(whole))
    own = flac.encode([flac.payload(b"own")])[0]
    assert flac.decode([made, own, made]) == [data, flac.payload(b"own"), data]
    w = size // 8
    assert flac.seek(made, 500, 700) == data[500 * w : 1200 * w] and flac.seek(made, len(whole) - 3, 9) == data[-3 * w :] and flac.seek(made, len(whole), 1) == b""
    for at in (len(made) - 1, len(made) // 2, 12 + 20, 60):
        with pytest.raises(ValueError):
            flac.decode([made[:at] + bytes([made[at] ^ 4]) + made[at + 1 :]])
    for n in (3, 20, 60, len(made) - 1, len(made) - 40):
        with pytest.raises(ValueError):
            flac.decode([made[:n]])


@pytest.mark.parametrize("code", [1, 8, 9, 10])
def test_stereo(code):
    n, left = 128, walk(128, 30_000)
    right = [v + RNG.randint(-3, 3) for v in left]
    side = [a - b for a, b in zip(left, right, strict=True)]
    middle = [(a + b) >> 1 for a, b in zip(left, right, strict=True)]
    plain = {"weights": (1,), "parameters": (3,)}
    parts = {1: (left, right), 8: (left, side), 9: (side, right), 10: (middle, side)}[code]
    extra = {1: (0, 0), 8: (0, 1), 9: (1, 0), 10: (0, 1)}[code]
    made = stream([frame(0, n, code, 16, [(x, 16 + e, "fixed", plain) for x, e in zip(parts, extra, strict=True)])], pcm([left, right], 2), n, 2, 16, n, extra=False)
    assert flac.decode([made]) == [pcm([left, right], 2)] and flac.seek(made, 7, 5) == pcm([left, right], 2)[28:48]


def test_own_frames_without_all_seek_points():
    """A stream of this encoder whose table lost every second point, as very long ones do, is decoded by its frames' ends."""
    data = flac.payload(bytes(RNG.randrange(32, 127) for _ in range(5 * flac.BLOCK + 10)))
    own = flac.encode([data])[0]
    at = own.index(b"\x83") if own[42] != 0x83 else 42
    n = int.from_bytes(own[at + 1 : at + 4], "big")
    points = own[at + 4 : at + 4 + n]
    thin = b"".join(points[i : i + 18] for i in range(0, n, 36))
    less = own[: at + 1] + len(thin).to_bytes(3, "big") + thin + own[at + 4 + n :]
    assert flac.decode([less, own]) == [data, data] and flac.seek(less, 3000, 2500) == data[3000:5500] == flac.seek(own, 3000, 2500)


def test_pcm_blocks_of_stereo(spark, tmp_path):
    n, left, right = 2500, walk(2500, 3000), walk(2500, 3000)
    made = stream([frame(0, n, 1, 16, [(left, 16, "verbatim", {}), (right, 16, "verbatim", {})])], pcm([left, right], 2), n, 2, 16, n)
    flac.write_pcm(spark.createDataFrame([(1, bytearray(made))], "doc_id long, _tw_media binary"), str(tmp_path / "pcm"))
    rows = sorted(spark.read.parquet(str(tmp_path / "pcm")).collect(), key=lambda r: r.block)
    assert [r.first_sample for r in rows] == [0, 1024, 2048] and b"".join(bytes(r.pcm) for r in rows) == pcm([left, right], 2)
