"""Bar codes besides Code 128: EAN-13, EAN-8, UPC-A, UPC-E, Code 39, interleaved 2 of 5 and Codabar.

Encoding is for fixtures. Decoding works on the runs of one row of dark pixels: a symbol begins at a dark run behind
a light one that is at least half as wide as the symbol's start pattern (or at the edge), and ends alike.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

FORMATS = ("EAN_13", "EAN_8", "UPC_A", "UPC_E", "CODE_39", "ITF", "CODABAR")

# Widths of the four runs of the digits 0-9 in EAN symbols.
_DIGITS = "3211 2221 2122 1411 1132 1231 1114 1312 1213 3112".split()
# Which left digits are mirrored (G) for each first digit 0-9 of EAN-13.
_FIRST = "LLLLLL LLGLGG LLGGLG LLGGGL LGLLGG LGGLLG LGGGLL LGLGLG LGLGGL LGGLGL".split()
# Which digits of UPC-E are mirrored for each check digit 0-9, in number system 0.
_CHECKS = "GGGLLL GGLGLL GGLLGL GGLLLG GLGGLL GLLGGL GLLLGG GLGLGL GLGLLG GLLGLG".split()
# Wide (1) and narrow (0) of the five bars of the digits 0-9 in 2-of-5 codes.
_TWO_OF_FIVE = "00110 10001 01001 11000 00101 10100 01100 00011 10010 01010".split()
# Wide and narrow runs of Codabar's characters.
_CODABAR = dict(zip("0123456789-$:/.+ABCD", "0000011 0000110 0001001 1100000 0010010 1000010 0100001 0100100 0110000 1001000 0001100 0011000 1000101 1010001 1010100 0010101 0011010 0101001 0001011 0001110".split(), strict=True))
#: Shortest interleaved 2 of 5: shorter ones are too easily met by chance.
LEAST_ITF = 6


def _code39() -> dict[str, str]:
    """Wide and narrow runs of Code 39: four rows of ten share their bars and differ in the wide space."""
    out = {}
    for row, space in zip(("1234567890", "ABCDEFGHIJ", "KLMNOPQRST", "UVWXYZ-. *"), (1, 2, 3, 0), strict=True):
        for i, c in enumerate(row):
            spaces = ["1" if k == space else "0" for k in range(4)]
            out[c] = "".join(b + s for b, s in zip(_TWO_OF_FIVE[(i + 1) % 10], [*spaces, ""], strict=True))
    for c, narrow in zip("$/+%", (3, 2, 1, 0), strict=True):
        out[c] = "".join("0" + ("0" if k == narrow else "1") for k in range(4)) + "0"
    return out


_CODE39 = _code39()
_EAN_BACK = {tuple(map(int, w[::s])): (i, kind) for s, kind in ((1, "L"), (-1, "G")) for i, w in enumerate(_DIGITS)}
_CODE39_BACK = {w: c for c, w in _CODE39.items()}
_CODABAR_BACK = {w: c for c, w in _CODABAR.items()}
_TWO_BACK = {w: str(i) for i, w in enumerate(_TWO_OF_FIVE)}


def check_digit(digits: str) -> str:
    """The digit that follows the others in EAN and UPC numbers."""
    return str(-sum(int(c) * (3 if k % 2 == 0 else 1) for k, c in enumerate(reversed(digits))) % 10)


def widened(short: str) -> str:
    """The UPC-A number, without its check digit, of a number system and the six digits of a UPC-E symbol."""
    system, d, last = short[0], short[1:7], short[6]
    if last in "012":
        return system + d[:2] + last + "0000" + d[2:5]
    if last in "34":
        return system + d[: int(last)] + "0" * (8 - int(last)) + d[int(last) : 5]
    return system + d[:5] + "0000" + last


def _runs(kind: str, text: str) -> str:
    """Widths of the runs of a symbol, dark first; narrow and wide ones are 1 and 3."""
    wide = str.maketrans("01", "13")
    if kind in ("EAN_13", "UPC_A", "EAN_8"):
        digits = "0" + text if kind == "UPC_A" else text
        digits += check_digit(digits)
        half = len(digits) // 2
        left = list(zip(digits[1:7], _FIRST[int(digits[0])], strict=True)) if half == 6 else [(c, "L") for c in digits[:4]]
        return "111" + "".join(_DIGITS[int(c)][:: 1 if k == "L" else -1] for c, k in left) + "11111" + "".join(_DIGITS[int(c)] for c in digits[-half if half == 4 else -6 :]) + "111"
    if kind == "UPC_E":
        mirrored = _CHECKS[int(check_digit(widened(text)))]
        if text[0] == "1":
            mirrored = mirrored.translate(str.maketrans("LG", "GL"))
        return "111" + "".join(_DIGITS[int(c)][:: 1 if k == "L" else -1] for c, k in zip(text[1:], mirrored, strict=True)) + "111111"
    if kind == "CODE_39":
        return "1".join(_CODE39[c].translate(wide) for c in f"*{text}*")
    if kind == "CODABAR":
        return "1".join(_CODABAR[c].translate(wide) for c in text)
    pairs = zip(text[::2], text[1::2], strict=True)
    return "1111" + "".join(b + s for p, q in pairs for b, s in zip(_TWO_OF_FIVE[int(p)].translate(wide), _TWO_OF_FIVE[int(q)].translate(wide), strict=True)) + "311"


def encode(kind: str, text: str) -> np.ndarray:
    """Dark modules of a text with quiet zones. EAN and UPC numbers come without their check digit, Codabar with its start and stop letters."""
    out = [False] * 10
    for i, w in enumerate(_runs(kind, text)):
        out += [i % 2 == 0] * int(w)
    return np.array(out + [False] * 10)


def _wide(part: list[float]) -> str:
    """Which runs are wide; empty if narrow and wide ones can't be told apart."""
    order = sorted(part)
    gaps = [b / a for a, b in zip(order, order[1:])]
    cut = gaps.index(max(gaps))
    if gaps[cut] < 1.5 or order[cut] > 2 * order[0] or order[-1] > 2 * order[cut + 1]:
        return ""
    return "".join("1" if w > order[cut] else "0" for w in part)


def _ean_digit(part: list[float]) -> tuple[int, str] | None:
    total = sum(part)
    return _EAN_BACK.get(tuple([round(w * 7 / total) for w in part])) if len(part) == 4 else None


def _even(part: list[float], unit: float) -> bool:
    """Whether all runs are about one module wide."""
    return len(part) > 0 and all(abs(w - unit) <= 0.6 * unit for w in part)


def _digits(width: list[float], at: int, n: int) -> list | None:
    found = [_ean_digit(width[at + 4 * k : at + 4 * k + 4]) for k in range(n)]
    return None if None in found else found


def _ean(width: list[float], i: int) -> tuple[str, str, int] | None:
    """An EAN or UPC symbol whose first bar is run ``i``: (format, text, number of runs)."""
    unit = sum(width[i : i + 3]) / 3
    if not _even(width[i : i + 3], unit):
        return None
    for half, n in ((6, 59), (4, 43)):
        if i + n <= len(width):
            middle = i + 3 + 4 * half
            if _even(width[middle : middle + 5], unit) and _even(width[i + n - 3 : i + n], unit):
                left, right = _digits(width, i + 3, half), _digits(width, middle + 5, half)
                if left and right and all(k == "L" for _, k in right):
                    kinds, text = "".join(k for _, k in left), "".join(str(d) for d, _ in left + right)
                    if half == 6 and kinds in _FIRST:
                        text = str(_FIRST.index(kinds)) + text
                    elif half == 6 or kinds != "LLLL":
                        continue
                    if check_digit(text[:-1]) == text[-1]:
                        if half == 6:
                            return ("UPC_A", text[1:], n) if text[0] == "0" else ("EAN_13", text, n)
                        return "EAN_8", text, n
    if i + 33 <= len(width) and _even(width[i + 27 : i + 33], unit):
        six = _digits(width, i + 3, 6)
        if six:
            kinds, short = "".join(k for _, k in six), "".join(str(d) for d, _ in six)
            for system, marks in (("0", kinds), ("1", kinds.translate(str.maketrans("LG", "GL")))):
                if marks in _CHECKS and check_digit(widened(system + short)) == str(_CHECKS.index(marks)):
                    return "UPC_E", f"{system}{short}{_CHECKS.index(marks)}", 33
    return None


def _spelled(width: list[float], i: int, n: int, back: dict[str, str], ends: str) -> tuple[str, int] | None:
    """Characters of ``n`` runs with a gap between them, from one in ``ends`` to the next: (text, number of runs)."""
    text, k = "", i
    while k + n <= len(width):
        c = back.get(_wide(width[k : k + n]))
        if c is None or (not text and c not in ends) or (text and width[k - 1] > max(width[k : k + n]) * 1.5):
            return None
        text, k = text + c, k + n + 1
        if len(text) > 1 and c in ends:
            return text, k - 1 - i
    return None


def _code39_at(width: list[float], i: int) -> tuple[str, str, int] | None:
    got = _spelled(width, i, 9, _CODE39_BACK, "*")
    return ("CODE_39", got[0][1:-1], got[1]) if got and len(got[0]) > 2 else None


def _codabar(width: list[float], i: int) -> tuple[str, str, int] | None:
    """The text goes without its start and stop letters."""
    got = _spelled(width, i, 7, _CODABAR_BACK, "ABCD")
    return ("CODABAR", got[0][1:-1], got[1]) if got and len(got[0]) > 2 else None


def _itf(width: list[float], i: int) -> tuple[str, str, int] | None:
    unit = sum(width[i : i + 4]) / 4
    if not _even(width[i : i + 4], unit) or (i > 0 and i > 1 and width[i - 1] < 5 * unit):
        return None
    text, k = "", i + 4
    while k + 10 <= len(width):
        pair = [_TWO_BACK.get(_wide(width[k + s : k + 10 : 2])) for s in (0, 1)]
        if None in pair:
            break
        text, k = text + "".join(pair), k + 10
    end = width[k : k + 3]
    if len(text) < LEAST_ITF or len(end) < 3 or not (1.5 * unit < end[0] < 4 * unit and _even(end[1:], unit)):
        return None
    return "ITF", text, k + 3 - i


#: Decoders, the runs of their start patterns, and their formats.
_READERS: tuple[tuple[Callable, int, tuple], ...] = (
    (_ean, 3, ("EAN_13", "EAN_8", "UPC_A", "UPC_E")), (_code39_at, 9, ("CODE_39",)), (_itf, 4, ("ITF",)), (_codabar, 7, ("CODABAR",)),
)


def decode_all(row: np.ndarray, formats: tuple = FORMATS) -> list[tuple[str, str, int, int]]:
    """(format, text, first, last pixel) of the valid symbols in a row, from left to right."""
    at = np.concatenate([[0], np.flatnonzero(row[1:] != row[:-1]) + 1, [len(row)]])
    dark = np.arange(0 if len(row) and row[0] else 1, len(at) - 1, 2)
    readers = [r for r in _READERS if set(r[2]) & set(formats)]
    # dark runs behind a light one that is wide enough, for each reader
    quiet = at[dark] - at[np.maximum(dark - 1, 0)]
    begins = np.array([(dark <= 1) | (2 * quiet >= at[np.minimum(dark + n, len(at) - 1)] - at[dark]) for _, n, _ in readers]).reshape(len(readers), -1)
    tried = begins.any(0)
    width, at = np.diff(at).astype(float).tolist(), at.tolist()
    out, behind = [], 0
    for i, may in zip(dark[tried].tolist(), begins[:, tried].T.tolist()):
        if i < behind:
            continue
        for (read, n, _), begin in zip(readers, may):
            got = read(width, i) if begin else None
            if got and got[0] in formats and (i + got[2] >= len(width) - 1 or width[i + got[2]] >= sum(width[i + got[2] - n : i + got[2]]) / 2):
                out.append((got[0], got[1], at[i], at[i + got[2]]))
                behind = i + got[2] + 1
                break
    return out
