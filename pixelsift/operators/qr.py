"""QR symbols of versions 1 to 40 in numpy: encoding (for tests and fixtures), locating and decoding.

A symbol is located by its three finder patterns, in any turn and at any scale; modules are sampled
through the affine map they define. Payload bytes, text and raw codewords are kept apart.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

# Fixed values, versions 1 to 40: check codewords of a block, by level of error correction.
_CHECKS = {
    "L": (7, 10, 15, 20, 26, 18, 20, 24, 30, 18, 20, 24, 26, 30, 22, 24, 28, 30, 28, 28, 28, 28, 30, 30, 26, 28, *[30] * 14),
    "M": (10, 16, 26, 18, 24, 16, 18, 22, 22, 26, 30, 22, 22, 24, 24, 28, 28, 26, 26, 26, 26, *[28] * 19),
    "Q": (13, 22, 18, 26, 18, 24, 18, 22, 20, 24, 28, 26, 24, 20, 30, 24, 28, 28, 26, 30, 28, 30, 30, 30, 30, 28, *[30] * 14),
    "H": (17, 28, 22, 16, 22, 28, 26, 26, 24, 28, 24, 28, 22, 24, 24, 30, 28, 28, 26, 28, 30, 24, *[30] * 18),
}
# Fixed values, versions 1 to 40: blocks, by level of error correction.
_BLOCKS = {
    "L": (1, 1, 1, 1, 1, 2, 2, 2, 2, 4, 4, 4, 4, 4, 6, 6, 6, 6, 7, 8, 8, 9, 9, 10, 12, 12, 12, 13, 14, 15, 16, 17, 18, 19, 19, 20, 21, 22, 24, 25),
    "M": (1, 1, 1, 2, 2, 4, 4, 4, 5, 5, 5, 8, 9, 9, 10, 10, 11, 13, 14, 16, 17, 17, 18, 20, 21, 23, 25, 26, 28, 29, 31, 33, 35, 37, 38, 40, 43, 45, 47, 49),
    "Q": (1, 1, 2, 2, 4, 4, 6, 6, 8, 8, 8, 10, 12, 16, 12, 17, 16, 18, 21, 20, 23, 23, 25, 27, 29, 34, 34, 35, 38, 40, 43, 45, 48, 51, 53, 56, 59, 62, 65, 68),
    "H": (1, 1, 2, 4, 4, 4, 5, 6, 8, 8, 11, 11, 16, 16, 18, 16, 19, 21, 25, 25, 25, 34, 30, 32, 35, 37, 40, 42, 45, 48, 51, 54, 57, 60, 63, 66, 70, 74, 77, 81),
}
# Two bits of each level, characters of the alphanumeric mode.
_LEVEL_BITS = {"L": 1, "M": 0, "Q": 3, "H": 2}
_ALNUM = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ $%*+-./:"
MOST = 40
#: Module sizes between two finder patterns of a symbol, at most: 170 in the largest version, and as module sizes are measured along rows, more when turned.
REACH = 260

_EXP = [1]
while len(_EXP) < 255:
    _EXP.append(_EXP[-1] * 2 ^ (0x11D if _EXP[-1] & 128 else 0))
_LOG = {v: i for i, v in enumerate(_EXP)}


def _mul(a: int, b: int) -> int:
    return _EXP[(_LOG[a] + _LOG[b]) % 255] if a and b else 0


def _inv(a: int) -> int:
    return _EXP[-_LOG[a] % 255]


def rs_encode(data: list[int], checks: int) -> list[int]:
    gen = [1]
    for i in range(checks):
        gen = [a ^ _mul(b, _EXP[i]) for a, b in zip([*gen, 0], [0, *gen])]
    rest = [0] * checks
    for d in data:
        top = d ^ rest[0]
        rest = [r ^ _mul(top, g) for r, g in zip([*rest[1:], 0], gen[1:])]
    return rest


def rs_decode(code: list[int], checks: int) -> list[int]:
    """Data codewords with up to half as many errors as checks put right; ValueError beyond."""
    synd = []
    for i in range(checks):
        s = 0
        for c in code:
            s = _mul(s, _EXP[i]) ^ c
        synd.append(s)
    if any(synd):
        loc, old, shift = [1], [1], 1  # error locator, lowest power first (Berlekamp-Massey)
        size, last = 0, 1
        for n in range(checks):
            delta = synd[n]
            for i in range(1, size + 1):
                delta ^= _mul(loc[i] if i < len(loc) else 0, synd[n - i])
            if delta == 0:
                shift += 1
                continue
            scale = _mul(delta, _inv(last))
            new = [a ^ b for a, b in zip(loc + [0] * (shift + len(old) - len(loc)), [0] * shift + [_mul(scale, x) for x in old] + [0] * max(0, len(loc) - shift - len(old)))]
            if 2 * size <= n:
                old, last, size, shift = loc, delta, n + 1 - size, 1
            else:
                shift += 1
            loc = new
        while loc and loc[-1] == 0:
            loc.pop()
        value = lambda poly, x: sum_xor(_mul(c, _EXP[_LOG[x] * i % 255]) for i, c in enumerate(poly))
        wrong = [i for i in range(len(code)) if value(loc, _EXP[-(len(code) - 1 - i) % 255]) == 0]
        if len(wrong) != len(loc) - 1 or 2 * len(wrong) > checks:
            raise ValueError("too many errors")
        omega = [sum_xor(_mul(synd[k - j], loc[j]) for j in range(min(k, len(loc) - 1) + 1)) for k in range(checks)]
        slope = [c if i % 2 == 0 else 0 for i, c in enumerate(loc[1:])]
        code = list(code)
        for i in wrong:
            x = _EXP[(len(code) - 1 - i) % 255]
            code[i] ^= _mul(x, _mul(value(omega, _inv(x)), _inv(value(slope, _inv(x)))))
    return list(code[: len(code) - checks])


def sum_xor(values) -> int:
    out = 0
    for v in values:
        out ^= v
    return out


def _raw_words(version: int) -> int:
    n = (16 * version + 128) * version + 64
    if version > 1:
        marks = version // 7 + 2
        n -= (25 * marks - 10) * marks - 55
        n -= 36 if version > 6 else 0
    return n // 8


def _centres(version: int) -> list[int]:
    if version == 1:
        return []
    marks = version // 7 + 2
    step = (version * 8 + marks * 3 + 5) // (marks * 4 - 4) * 2
    return [6, *reversed([version * 4 + 10 - i * step for i in range(marks - 1)])]


def _format_bits(level: str, mask: int) -> int:
    data = _LEVEL_BITS[level] << 3 | mask
    rest = data
    for _ in range(10):
        rest = rest << 1 ^ (rest >> 9) * 0x537
    return (data << 10 | rest) ^ 0x5412


def _version_bits(version: int) -> int:
    rest = version
    for _ in range(12):
        rest = rest << 1 ^ (rest >> 11) * 0x1F25
    return version << 12 | rest


def _format_places(size: int) -> list[list[tuple[int, int]]]:
    first = [(8, i) for i in range(6)] + [(8, 7), (8, 8), (7, 8)] + [(14 - i, 8) for i in range(9, 15)]
    return [first, [(size - 1 - i, 8) for i in range(8)] + [(8, size - 15 + i) for i in range(8, 15)]]


def _frame(version: int) -> tuple[np.ndarray, np.ndarray]:
    """Function modules and where they are, indexed [y, x]."""
    n = 17 + 4 * version
    dark, fixed = np.zeros((n, n), bool), np.zeros((n, n), bool)
    fixed[6, :] = fixed[:, 6] = True
    dark[6, ::2] = dark[::2, 6] = True
    for cx, cy in ((3, 3), (n - 4, 3), (3, n - 4)):
        for y in range(max(0, cy - 4), min(n, cy + 5)):
            for x in range(max(0, cx - 4), min(n, cx + 5)):
                fixed[y, x] = True
                dark[y, x] = max(abs(x - cx), abs(y - cy)) not in (2, 4)
    marks = _centres(version)
    for cx in marks:
        for cy in marks:
            if (cx, cy) not in ((6, 6), (6, n - 7), (n - 7, 6)):
                for y in range(cy - 2, cy + 3):
                    for x in range(cx - 2, cx + 3):
                        fixed[y, x], dark[y, x] = True, max(abs(x - cx), abs(y - cy)) != 1
    for places in _format_places(n):
        for x, y in places:
            fixed[y, x] = True
    fixed[n - 8, 8] = dark[n - 8, 8] = True
    if version > 6:
        bits = _version_bits(version)
        for i in range(18):
            a, b = n - 11 + i % 3, i // 3
            for x, y in ((a, b), (b, a)):
                fixed[y, x], dark[y, x] = True, bits >> i & 1
    return dark, fixed


def _path(fixed: np.ndarray) -> list[tuple[int, int]]:
    n, out = len(fixed), []
    for right in [r if r > 6 else r - 1 for r in range(n - 1, 0, -2)]:
        up = (right + 1) & 2 == 0
        for k in range(n):
            y = n - 1 - k if up else k
            out += [(y, x) for x in (right, right - 1) if not fixed[y, x]]
    return out


def _mask(kind: int, n: int) -> np.ndarray:
    y, x = np.mgrid[0:n, 0:n]
    return [(x + y) % 2, y % 2, x % 3, (x + y) % 3, (x // 3 + y // 2) % 2, x * y % 2 + x * y % 3, (x * y % 2 + x * y % 3) % 2, ((x + y) % 2 + x * y % 3) % 2][kind] == 0


def encode(data: bytes, version: int | None = None, level: str = "M", mask: int = 0, append: tuple[int, int, int] | None = None) -> np.ndarray:
    """Dark modules of a symbol with one byte segment; append: (index, total, parity)."""
    head = 20 if append else 0
    for v in [version] if version else range(1, MOST + 1):
        words, checks, blocks = _raw_words(v), _CHECKS[level][v - 1], _BLOCKS[level][v - 1]
        room = words - checks * blocks
        count = 8 if v < 10 else 16
        if head + 4 + count + 8 * len(data) <= 8 * room:
            break
    else:
        raise ValueError("the data is too long")
    bits = f"0011{append[0]:04b}{append[1] - 1:04b}{append[2]:08b}" if append else ""
    bits += "0100" + format(len(data), f"0{count}b") + "".join(f"{b:08b}" for b in data)
    bits += "0" * min(4, 8 * room - len(bits))
    bits += "0" * (-len(bits) % 8)
    code = [int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)]
    code += [(0xEC, 0x11)[i % 2] for i in range(room - len(code))]
    short, longer = words // blocks - checks, words % blocks
    parts, at = [], 0
    for b in range(blocks):
        n = short + (b >= blocks - longer)
        parts.append((code[at : at + n], rs_encode(code[at : at + n], checks)))
        at += n
    stream = [d[i] for i in range(short + 1) for d, _ in parts if i < len(d)] + [c[i] for i in range(checks) for _, c in parts]
    dark, fixed = _frame(v)
    flat = [w >> (7 - i) & 1 for w in stream for i in range(8)]
    for (y, x), bit in zip(_path(fixed), flat):
        dark[y, x] = bit
    dark ^= _mask(mask, len(dark)) & ~fixed
    code_bits = _format_bits(level, mask)
    for places in _format_places(len(dark)):
        for i, (x, y) in enumerate(places):
            dark[y, x] = code_bits >> i & 1
    return dark


@dataclass
class Symbol:
    """What a symbol holds. payload: bytes of its byte segments; raw: data codewords after correction."""

    payload: bytes
    text: str
    raw: bytes
    version: int
    level: str
    segments: list[bytes] = field(default_factory=list)
    append: tuple[int, int, int] | None = None
    points: list[tuple[float, float]] = field(default_factory=list)


def decode_modules(dark: np.ndarray) -> Symbol:
    n = len(dark)
    version = (n - 17) // 4
    if not 1 <= version <= MOST or n != 17 + 4 * version:
        raise ValueError("no such size")
    seen = [sum(int(dark[y, x]) << i for i, (x, y) in enumerate(p)) for p in _format_places(n)]
    far, level, mask = min((min((s ^ _format_bits(lv, m)).bit_count() for s in seen), lv, m) for lv in _LEVEL_BITS for m in range(8))
    if far > 3:
        raise ValueError("no format information")
    _, fixed = _frame(version)
    clear = dark ^ _mask(mask, n)
    bits = [int(clear[y, x]) for y, x in _path(fixed)]
    words, checks, blocks = _raw_words(version), _CHECKS[level][version - 1], _BLOCKS[level][version - 1]
    stream = [int("".join(map(str, bits[8 * i : 8 * i + 8])), 2) for i in range(words)]
    short, longer = words // blocks - checks, words % blocks
    sizes = [short + (b >= blocks - longer) for b in range(blocks)]
    parts: list[list[int]] = [[] for _ in range(blocks)]
    at = iter(stream)
    for i in range(short + 1):
        for b in range(blocks):
            if i < sizes[b]:
                parts[b].append(next(at))
    for _ in range(checks):
        for b in range(blocks):
            parts[b].append(next(at))
    data = bytes(w for p in parts for w in rs_decode(p, checks))
    return _read(data, version, level)


def _read(data: bytes, version: int, level: str) -> Symbol:
    bits, at = "".join(f"{b:08b}" for b in data), 0

    def take(n: int) -> int:
        nonlocal at
        if at + n > len(bits):
            raise ValueError("the data is cut off")
        at += n
        return int(bits[at - n : at] or "0", 2)

    wide, text, segments, append = (version > 9) + (version > 26), [], [], None
    while len(bits) - at >= 4:
        mode = take(4)
        if mode == 0:
            break
        if mode == 3:
            append = (take(4), take(4) + 1, take(8))
        elif mode == 7:
            first = take(8)
            take(0 if first < 128 else 8 if first < 192 else 16)
        elif mode == 1:
            n = take(10 + 2 * wide)
            text.append("".join(f"{take({3: 10, 2: 7, 1: 4}[k]):0{k}d}" for k in [3] * (n // 3) + [n % 3] * (n % 3 > 0)))
        elif mode == 2:
            n = take(9 + 2 * wide)
            text.append("".join(_ALNUM[(v := take(11)) // 45] + _ALNUM[v % 45] for _ in range(n // 2)) + (_ALNUM[take(6)] if n % 2 else ""))
        elif mode == 4:
            segment = bytes(take(8) for _ in range(take(16 if wide else 8)))
            segments.append(segment)
            try:
                text.append(segment.decode())
            except UnicodeDecodeError:
                text.append(segment.decode("latin-1"))
        elif mode == 8:
            pairs = [take(13) for _ in range(take(8 + 2 * wide))]
            codes = [(p // 0xC0 << 8 | p % 0xC0) for p in pairs]
            text.append(b"".join((c + (0x8140 if c + 0x8140 <= 0x9FFC else 0xC140)).to_bytes(2, "big") for c in codes).decode("shift_jis", "replace"))
        elif mode not in (5, 9):
            raise ValueError(f"unknown mode {mode}")
    return Symbol(b"".join(segments), "".join(text), data, version, level, segments, append)


def _finders(dark: np.ndarray) -> list[tuple[float, float, float]]:
    """Centres (x, y) and module sizes of finder patterns: runs 1:1:3:1:1 both ways.

    All runs of all rows are tried at once; columns are looked at where a row fits, each of them once."""
    h, w = dark.shape
    if np.count_nonzero((dark[1:] != dark[:-1]).any(1)) < 4:  # no column has five runs
        return []

    def fits(at: np.ndarray) -> np.ndarray:
        """Whether the five runs from each place on, up to the fifth last, have the widths of a pattern."""
        a, b, c, d, e = (at[k + 1 : len(at) - 4 + k] - at[k : len(at) - 5 + k] for k in range(5))
        unit = (a + b + c + d + e) / 7
        return (unit >= 1) & (np.max([abs(x - unit) for x in (a, b, d, e)], axis=0) <= unit * 0.6) & (abs(c - 3 * unit) <= unit * 1.2)

    # where runs of all rows start, and where the last of each ends, row by row
    edge = np.ones((h, w + 1), bool)
    np.not_equal(dark[:, 1:], dark[:, :-1], out=edge[:, 1:-1])
    rows, at = np.nonzero(edge)
    if len(at) < 6:
        return []
    like = np.flatnonzero((rows[5:] == rows[:-5]) & fits(at))
    like = like[dark[rows[like], at[like]]]
    columns: dict[int, tuple[np.ndarray, np.ndarray] | None] = {}
    found: list[list[float]] = []
    for y, x, unit in zip(rows[like].tolist(), ((at[like + 2] + at[like + 3]) / 2).tolist(), ((at[like + 5] - at[like]) / 7).tolist(), strict=True):
        if int(x) not in columns:
            column = dark[:, int(x)]
            down = np.concatenate([[0], np.flatnonzero(column[1:] != column[:-1]) + 1, [h]])
            good = fits(down) if len(down) > 5 else np.zeros(0, bool)
            columns[int(x)] = (down, good) if good.any() else None
        if columns[int(x)] is None:
            continue
        down, good = columns[int(x)]
        k = int(np.searchsorted(down, y, side="right")) - 1
        if 2 <= k < len(down) - 3 and good[k - 2]:
            cy = (down[k] + down[k + 1]) / 2
            for f in found:
                if abs(f[0] - x) < 2.5 * unit and abs(f[1] - cy) < 2.5 * unit:
                    f[0], f[1], f[2], f[3] = (f[0] * f[3] + x) / (f[3] + 1), (f[1] * f[3] + cy) / (f[3] + 1), (f[2] * f[3] + unit) / (f[3] + 1), f[3] + 1
                    break
            else:
                found.append([x, cy, unit, 1])
    return [(f[0], f[1], f[2]) for f in found]


def locate(dark: np.ndarray, most: int = 32) -> list[Symbol]:
    """Symbols in a picture of dark pixels; every finder pattern belongs to one symbol at most."""
    finders = _finders(dark)
    where, unit_of = np.array([f[:2] for f in finders]).reshape(-1, 2), np.array([f[2] for f in finders])
    tries = []
    for corner in range(len(finders)):
        away, like = where - where[corner], np.maximum(unit_of, unit_of[corner]) <= 1.6 * np.minimum(unit_of, unit_of[corner])
        far = np.hypot(away[:, 0], away[:, 1])
        near = np.flatnonzero(like & (far <= REACH * np.maximum(unit_of, unit_of[corner])) & (np.arange(len(finders)) != corner))
        v, size, own = away[near], far[near], unit_of[near]
        longer, product = np.maximum.outer(size, size), np.multiply.outer(size, size)
        fits = (abs(np.subtract.outer(size, size)) < 0.15 * longer) & (abs(v @ v.T) < 0.15 * product) & (np.maximum.outer(own, own) <= 1.6 * np.minimum.outer(own, own))
        for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(fits, 1))), strict=True):
            a, b = v[i], v[j]
            right, down = (a, b) if a[0] * b[1] - a[1] * b[0] > 0 else (b, a)
            tries.append((float(size[i] + size[j]), tuple(sorted((corner, int(near[i]), int(near[j])))), corner, right, down))
    used: set[int] = set()
    out: list[Symbol] = []
    for length, three, corner, right, down in sorted(tries, key=lambda t: t[:3]):
        if used & set(three) or len(out) >= most:
            continue
        unit = sum(finders[i][2] for i in three) / 3
        guess = (length / 2 / unit + 7 - 17) / 4
        for version in sorted(range(1, MOST + 1), key=lambda v: abs(v - guess))[: 3 + max(0, int(guess) // 6)]:  # the larger, the less exact is the guess
            n = 17 + 4 * version
            origin, ux, uy = np.array(finders[corner][:2]), right / (n - 7), down / (n - 7)
            place = np.arange(n) - 3
            px = origin[0] + place[None, :] * ux[0] + place[:, None] * uy[0]
            py = origin[1] + place[None, :] * ux[1] + place[:, None] * uy[1]
            xi, yi = np.floor(px).astype(int), np.floor(py).astype(int)
            if xi.min() < 0 or yi.min() < 0 or xi.max() >= dark.shape[1] or yi.max() >= dark.shape[0]:
                continue
            modules = dark[yi, xi]
            timing = np.concatenate([modules[6, 8:-8], modules[8:-8, 6]])
            if (timing == np.tile(np.arange(n - 16) % 2 == 0, 2)).mean() < 0.75:  # more wrong than any correction allows
                continue
            try:
                symbol = decode_modules(modules)
            except (ValueError, KeyError, IndexError):
                continue
            symbol.points = [tuple(map(float, p)) for p in (origin + down, origin, origin + right)]
            out.append(symbol)
            used |= set(three)
            break
    return out
