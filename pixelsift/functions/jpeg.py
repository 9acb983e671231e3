"""JPEG in numpy: an encoder (baseline, no subsampling, Huffman codes made for each image) and a decoder of
sequential files with Huffman codes. The transforms and the packing of bits are array operations."""

from __future__ import annotations

import heapq
import struct
from array import array

import numpy as np

# The steps for luminance and chrominance that the standard gives as examples, row by row.
_LUMINANCE = "16 11 10 16 24 40 51 61 12 12 14 19 26 58 60 55 14 13 16 24 40 57 69 56 14 17 22 29 51 87 80 62 18 22 37 56 68 109 103 77 24 35 55 64 81 104 113 92 49 64 78 87 103 121 120 101 72 92 95 98 112 100 103 99"
_CHROMINANCE = "17 18 24 47 99 99 99 99 18 21 26 66 99 99 99 99 24 26 56 99 99 99 99 99 47 66 99 99 99 99 99 99" + " 99" * 32

#: Places of a block in the order in which they are stored: along its diagonals, up and down by turns.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_K = np.arange(8)
_COSINES = np.where(_K[:, None] == 0, np.sqrt(1 / 8), np.sqrt(2 / 8) * np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16))
#: Symbols whose bits are packed at a time.
_AT_ONCE = 1 << 18


def steps(quality: int) -> np.ndarray:
    """Quantisation steps (luminance, chrominance) for a quality of 1 to 100."""
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    tables = np.array([list(map(int, t.split())) for t in (_LUMINANCE, _CHROMINANCE)])
    return np.clip((tables * scale + 50) // 100, 1, 255)


def _lengths(counts: np.ndarray) -> list[tuple[int, int]]:
    """(length, symbol) of a Huffman code of at most 16 bits, in the order of its codes, none of which is all ones."""
    used = np.flatnonzero(counts).tolist()
    weights = {s: int(counts[s]) for s in used} | {256: 1}  # 256 takes the code of all ones
    while True:
        heap = [(n, s, (s,)) for s, n in weights.items()]
        heapq.heapify(heap)
        size = dict.fromkeys(weights, 0)
        while len(heap) > 1:
            (n, a, left), (m, b, right) = heapq.heappop(heap), heapq.heappop(heap)
            for s in left + right:
                size[s] += 1
            heapq.heappush(heap, (n + m, max(a, b), left + right))
        if max(size.values()) <= 16:
            break
        weights = {s: 1 + n // 2 for s, n in weights.items()}
    order = sorted((n, s) for s, n in size.items())
    longest = order[-1][0]
    last = next(i for i, (n, s) in enumerate(order) if s == 256)
    if order[last][0] < longest:  # swap lengths with a longest one
        other = order[-1][1]
        order = sorted((longest if s == 256 else size[256] if s == other else n, s) for n, s in order)
    return [x for x in order if x[1] != 256]


def _codes(lengths: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Code and length by symbol."""
    code, size, now, before = np.zeros(256, np.int64), np.zeros(256, np.int64), 0, 0
    for n, s in lengths:
        now <<= n - before
        code[s], size[s] = now, n
        now, before = now + 1, n
    return code, size


def _bits_of(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The category of values and the bits that follow it."""
    n = np.ceil(np.log2(np.abs(v) + 1)).astype(np.int64)
    return n, np.where(v < 0, v + (1 << n) - 1, v)


def _packed(value: np.ndarray, size: np.ndarray) -> bytes:
    out, rest = [], np.empty(0, np.uint8)
    for lo in range(0, len(value), _AT_ONCE):
        v, n = value[lo : lo + _AT_ONCE], size[lo : lo + _AT_ONCE]
        bits = np.unpackbits(v.astype(">u4").view(np.uint8)).reshape(-1, 32)
        bits = np.concatenate([rest, bits[np.arange(32) >= 32 - n[:, None]]])
        whole = len(bits) // 8 * 8
        out.append(np.packbits(bits[:whole]).tobytes())
        rest = bits[whole:]
    if len(rest):
        out.append(np.packbits(np.concatenate([rest, np.ones(8 - len(rest), np.uint8)])).tobytes())
    return b"".join(out).replace(b"\xff", b"\xff\x00")


def encode(rgb: np.ndarray, quality: int = 75) -> bytes:
    """A picture of (height, width, 3) levels."""
    h, w, _ = rgb.shape
    if max(h, w) > 65535:
        raise ValueError("a JPEG has at most 65535 rows and columns")
    r, g, b = np.moveaxis(np.pad(rgb, ((0, -h % 8), (0, -w % 8), (0, 0)), "edge").astype(np.float32), 2, 0)
    y = 0.299 * r + 0.587 * g + 0.114 * b
    planes = np.stack([y - 128, (b - y) / 1.772, (r - y) / 1.402])
    blocks = planes.reshape(3, planes.shape[1] // 8, 8, -1, 8).transpose(1, 3, 0, 2, 4).reshape(-1, 3, 8, 8)
    table = steps(quality)
    levels = (_COSINES.astype(np.float32) @ blocks @ _COSINES.T.astype(np.float32)).reshape(-1, 3, 64) / table[[0, 1, 1]]
    z = np.rint(levels).astype(np.int64)[:, :, ZIGZAG]
    z[:, :, 0] = np.diff(z[:, :, 0], axis=0, prepend=0)
    z = z.reshape(-1, 64)
    n = len(z)
    block, k = np.nonzero(z[:, 1:])
    k += 1
    first = np.concatenate([[True], block[1:] != block[:-1]]) if len(block) else np.empty(0, bool)
    run = k - np.where(first, 0, np.concatenate([[0], k[:-1]]) if len(k) else k) - 1
    last = np.zeros(n, np.int64)
    np.maximum.at(last, block, k)
    open_ends = np.flatnonzero(last < 63)
    size, bits = _bits_of(z[block, k])
    size0, bits0 = _bits_of(z[:, 0])
    far = np.repeat(np.arange(len(run)), run // 16)
    # all symbols: first coefficients, runs of sixteen zeros, the others, ends of blocks
    at = np.concatenate([np.arange(n) * 130, block[far] * 130 + 2 * k[far] - 1, block * 130 + 2 * k, open_ends * 130 + 129])
    symbol = np.concatenate([size0, np.full(len(far), 0xF0), (run % 16) << 4 | size, np.zeros(len(open_ends), np.int64)])
    extra = np.concatenate([bits0, np.zeros(len(far), np.int64), bits, np.zeros(len(open_ends), np.int64)])
    width = np.concatenate([size0, np.zeros(len(far), np.int64), size, np.zeros(len(open_ends), np.int64)])
    kind = np.concatenate([np.zeros(n, np.int64), np.ones(len(at) - n, np.int64)]) + np.where(at // 130 % 3 > 0, 2, 0)
    order = np.argsort(at, kind="stable")
    symbol, extra, width, kind = symbol[order], extra[order], width[order], kind[order]
    trees = [_lengths(np.bincount(symbol[kind == t], minlength=256)) for t in range(4)]
    code, length = (np.stack(c)[kind, symbol] for c in zip(*map(_codes, trees), strict=True))
    body = _packed(code << width | extra, length + width)

    def segment(mark: int, data: bytes) -> bytes:
        return struct.pack(">BBH", 0xFF, mark, len(data) + 2) + data

    def tree(t: int) -> bytes:
        sizes = [s for s, _ in trees[t]]
        return bytes([(t % 2) << 4 | t // 2, *(sizes.count(s) for s in range(1, 17)), *(s for _, s in trees[t])])

    quantised = b"".join(bytes([t, *table[t][ZIGZAG].tolist()]) for t in range(2))
    frame = struct.pack(">BHHB", 8, h, w, 3) + bytes([1, 0x11, 0, 2, 0x11, 1, 3, 0x11, 1])
    return (
        b"\xff\xd8" + segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + segment(0xDB, quantised) + segment(0xC0, frame)
        + segment(0xC4, b"".join(map(tree, range(4)))) + segment(0xDA, bytes([3, 1, 0, 2, 0x11, 3, 0x11, 0, 63, 0])) + body + b"\xff\xd9"
    )


class _Bits:
    """Codes and bits of one interval of entropy-coded data; behind its end there are zeros."""

    def __init__(self, data: bytes):
        self.data, self.at, self.now, self.n = data.replace(b"\xff\x00", b"\xff"), 0, 0, 0

    def want(self, n: int) -> None:
        while self.n < n:
            if self.at > len(self.data) + 64:
                raise ValueError("the pixel data is cut off")
            self.now = (self.now & (1 << self.n) - 1) << 32 | int.from_bytes(self.data[self.at : self.at + 4].ljust(4, b"\0"), "big")
            self.at, self.n = self.at + 4, self.n + 32

    def symbol(self, table: list[int]) -> int:
        self.want(16)
        got = table[self.now >> self.n - 16 & 0xFFFF]
        if not got:
            raise ValueError("an unknown code")
        self.n -= got >> 8
        return got & 255

    def value(self, size: int) -> int:
        if not size:
            return 0
        if size > 15:
            raise ValueError("a coefficient of too many bits")
        self.want(size)
        self.n -= size
        v = self.now >> self.n & (1 << size) - 1
        return v if v >> size - 1 else v - (1 << size) + 1


def _lookup(counts: bytes, symbols: bytes) -> list[int]:
    """Length and symbol (length * 256 + symbol) by the next sixteen bits."""
    out, at = np.zeros(1 << 16, np.int64), 0
    where = 0
    for size, n in enumerate(counts, 1):
        for _ in range(n):
            out[at : at + (1 << 16 - size)] = size << 8 | symbols[where]
            at, where = at + (1 << 16 - size), where + 1
    return out.tolist()


def _block(bits: _Bits, out: array, base: int, dc: list[int], ac: list[int], before: int) -> int:
    before += bits.value(bits.symbol(dc))
    if abs(before) >> 20:
        raise ValueError("coefficients out of range")
    out[base] = before
    k = 1
    while k < 64:
        s = bits.symbol(ac)
        if s & 15:
            k += s >> 4
            if k > 63:
                raise ValueError("a coefficient outside its block")
            out[base + k] = bits.value(s & 15)
            k += 1
        elif s == 0xF0:
            k += 16
        else:
            break
    return before


def _intervals(d: bytes, at: int) -> tuple[list[bytes], int]:
    """The entropy-coded data from ``at`` on, cut at restart marks, and where the next other mark is."""
    parts, begun = [], at
    while True:
        at = d.find(b"\xff", at)
        if at < 0 or at + 1 >= len(d):
            return [*parts, d[begun:]], len(d)
        mark = d[at + 1]
        if mark == 0 or mark == 0xFF:
            at += 2 if mark == 0 else 1
        elif 0xD0 <= mark <= 0xD7:
            parts.append(d[begun:at])
            begun = at = at + 2
        else:
            return [*parts, d[begun:at]], at


def decode(d: bytes, check_size=lambda w, h: None) -> np.ndarray:
    """Levels of a sequential file: (height, width, 3), or (height, width, 1) if it has one component. Components that
    are stored smaller are repeated, not smoothed."""
    quant: dict[int, np.ndarray] = {}
    trees: dict[int, list[int]] = {}
    parts: dict[int, dict] = {}
    at, every, adobe, w, h = 2, 0, None, 0, 0
    while at + 4 <= len(d):
        if d[at] != 0xFF or d[at + 1] == 0xFF:
            at += 1
            continue
        mark = d[at + 1]
        if mark == 0xD9:
            break
        if mark in (0, 1) or 0xD0 <= mark <= 0xD8:
            at += 2
            continue
        size = int.from_bytes(d[at + 2 : at + 4], "big")
        data, at = d[at + 4 : at + 2 + size], at + 2 + size
        if mark == 0xDB:
            while data:
                wide, t = data[0] >> 4, data[0] & 15
                quant[t] = np.frombuffer(data, ">u2" if wide else np.uint8, 64, 1).astype(np.int32)
                data = data[1 + 64 * (1 + (wide > 0)) :]
        elif mark == 0xC4:
            while data:
                n = sum(data[1:17])
                trees[data[0]] = _lookup(data[1:17], data[17 : 17 + n])
                data = data[17 + n :]
        elif mark in (0xC0, 0xC1):
            depth, h, w, n = struct.unpack(">BHHB", data[:6])
            check_size(w, h)
            if depth != 8 or n not in (1, 3):
                raise ValueError(f"{n} components of {depth} bits aren't decoded")
            for c in range(n):
                name, ratio, t = data[6 + 3 * c : 9 + 3 * c]
                parts[name] = {"x": ratio >> 4, "y": ratio & 15, "t": t}
            if w * h > 256 * len(d):  # a block of 64 takes two bits at least
                raise ValueError("the pixel data is cut off")
            if any(not (1 <= p[s] <= 4) for p in parts.values() for s in "xy"):
                raise ValueError("impossible sampling")
            xs, ys = max(p["x"] for p in parts.values()), max(p["y"] for p in parts.values())
            across, down = -(-w // (8 * xs)), -(-h // (8 * ys))
            for p in parts.values():
                p["wide"], p["high"] = across * p["x"], down * p["y"]
                p["data"] = array("i", bytes(4 * 64 * p["wide"] * p["high"]))
        elif 0xC2 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only sequential JPEG files with Huffman codes are decoded")
        elif mark == 0xDD:
            every = int.from_bytes(data[:2], "big")
        elif mark == 0xEE and data[:5] == b"Adobe":
            adobe = data[11]
        elif mark == 0xDA:
            if not parts:
                raise ValueError("a scan before its frame")
            found, at = _intervals(d, at)
            chosen = [(parts[data[1 + 2 * i]], trees[data[2 + 2 * i] >> 4], trees[16 | data[2 + 2 * i] & 15]) for i in range(data[0])]
            if len(chosen) == 1:  # its own blocks, without those that only fill the picture's last units
                p = chosen[0][0]
                cells = [[(chosen[0], y * p["wide"] + x)] for y in range(-(-(-(-h * p["y"] // ys)) // 8)) for x in range(-(-(-(-w * p["x"] // xs)) // 8))]
            else:
                cells = [
                    [(c, (my * c[0]["y"] + y) * c[0]["wide"] + mx * c[0]["x"] + x) for c in chosen for y in range(c[0]["y"]) for x in range(c[0]["x"])]
                    for my in range(down) for mx in range(across)
                ]
            step = every or len(cells)
            for i, part in enumerate(found[: -(-len(cells) // step)]):
                bits, before = _Bits(part), {id(c[0]): 0 for c in chosen}
                for cell in cells[i * step : (i + 1) * step]:
                    for (p, dc, ac), place in cell:
                        before[id(p)] = _block(bits, p["data"], 64 * place, dc, ac, before[id(p)])
    if not parts:
        raise ValueError("no frame")
    planes = []
    for p in parts.values():
        z = np.frombuffer(p["data"], np.int32).reshape(-1, 64) * quant[p["t"]]
        blocks = np.zeros((len(z), 64), np.float32)
        blocks[:, ZIGZAG] = z
        levels = _COSINES.T.astype(np.float32) @ blocks.reshape(-1, 8, 8) @ _COSINES.astype(np.float32) + 128
        plane = levels.reshape(p["high"], p["wide"], 8, 8).transpose(0, 2, 1, 3).reshape(8 * p["high"], 8 * p["wide"])
        if (p["x"], p["y"]) != (xs, ys):
            plane = plane[np.arange(8 * ys * down) * p["y"] // ys][:, np.arange(8 * xs * across) * p["x"] // xs]
        planes.append(np.clip(np.rint(plane[:h, :w]), 0, 255))
    if len(planes) == 3 and adobe != 0 and bytes(parts) != b"RGB":
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        planes = [y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb]
    return np.clip(np.rint(np.stack(planes, 2)), 0, 255).astype(np.uint8)
