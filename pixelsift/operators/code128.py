"""Code 128 bars: encoding (for fixtures) and decoding of rows of dark pixels."""

from __future__ import annotations

import numpy as np

# Widths of bars and spaces of the 106 codes, in their order, then the stop code.
_WIDTHS = (
    "212222 222122 222221 121223 121322 131222 122213 122312 132212 221213 221312 231212 112232 122132 122231 113222 123122 123221 223211 221132 "
    "221231 213212 223112 312131 311222 321122 321221 312212 322112 322211 212123 212321 232121 111323 131123 131321 112313 132113 132311 211313 "
    "231113 231311 112133 112331 132131 113123 113321 133121 313121 211331 231131 213113 213311 213131 311123 311321 331121 312113 312311 332111 "
    "314111 221411 431111 111224 111422 121124 121421 141122 141221 112214 112412 122114 122411 142112 142211 241211 221114 413111 241112 134111 "
    "111242 121142 121241 114212 124112 124211 411212 421112 421211 212141 214121 412121 111143 111341 131141 114113 114311 411113 411311 113141 "
    "114131 311141 411131 211412 211214 211232 2331112"
).split()
_CODES = {tuple(map(int, w)): i for i, w in enumerate(_WIDTHS)}
# Code by the widths as digits of a number of base 5; -1 if there is none.
_TABLES = {n: np.full(5**n, -1, np.int16) for n in (6, 7)}
for _w, _i in _CODES.items():
    _TABLES[len(_w)][sum(x * 5**k for k, x in enumerate(_w))] = _i
_STOP, _START = 106, {103: "A", 104: "B", 105: "C"}


def encode(text: str) -> np.ndarray:
    """Dark modules of a text of printable ASCII, in code set B, with quiet zones."""
    codes = [104, *(ord(c) - 32 for c in text)]
    codes += [(codes[0] + sum(i * c for i, c in enumerate(codes[1:], 1))) % 103, _STOP]
    out = [False] * 10
    for c in codes:
        for i, w in enumerate(_WIDTHS[c]):
            out += [i % 2 == 0] * int(w)
    return np.array(out + [False] * 10)


def _text(codes: list[int]) -> str:
    mode, out, shift = _START[codes[0]], [], None
    for c in codes[1:-2]:
        now, shift = shift or mode, None
        if now == "C" and c < 100:
            out.append(f"{c:02d}")
        elif c == 98 and now != "C":
            shift = "B" if now == "A" else "A"
        elif c in (99, 100, 101) and {99: "C", 100: "B", 101: "A"}[c] != now:
            mode = {99: "C", 100: "B", 101: "A"}[c]
        elif c < 96:
            out.append(chr(c + 32) if now == "B" or c < 64 else chr(c - 64))
    return "".join(out)


def _codes(width: np.ndarray, n: int, total: int) -> np.ndarray:
    """The code of the ``n`` runs from each run on, ``total`` modules wide; -1 if there is none."""
    out = np.full(len(width), -1, np.int16)
    if len(width) >= n:
        parts = np.array([width[k : len(width) - n + 1 + k] for k in range(n)])
        modules = np.rint(parts / (parts.sum(0) / total)).clip(1, 4)
        out[: len(parts[0])] = _TABLES[n][(5.0 ** np.arange(n) @ modules).astype(np.int64)]
    return out


def decode_all(row: np.ndarray) -> list[tuple[str, int, int]]:
    """(text, first, last pixel) of the valid symbols in a row, from left to right."""
    at = np.concatenate([[0], np.flatnonzero(row[1:] != row[:-1]) + 1, [len(row)]])
    width = np.diff(at).astype(float)
    six, seven = _codes(width, 6, 11), _codes(width, 7, 13)
    first = 0 if len(row) and row[0] else 1
    starts = first + 2 * np.flatnonzero(six[first::2] >= min(_START))
    if not len(starts):
        return []
    code = np.where(seven == _STOP, _STOP, six).tolist()
    out, behind = [], 0
    for i in starts.tolist():
        if i < behind or code[i] not in _START:
            continue
        codes, k = [code[i]], i + 6
        while k < len(code) and (c := code[k]) >= 0:
            codes.append(c)
            if c == _STOP:
                check = (codes[0] + sum(j * v for j, v in enumerate(codes[1:-2], 1))) % 103
                if len(codes) > 3 and check == codes[-2]:
                    out.append((_text(codes), int(at[i]), int(at[k + 7])))
                    behind = k + 7  # the next one starts behind it
                break
            k += 6
    return out


def decode_row(row: np.ndarray) -> tuple[str, int, int] | None:
    """(text, first, last pixel) of the first valid symbol in a row, or None."""
    return next(iter(decode_all(row)), None)
