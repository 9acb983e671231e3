"""Column expressions on packed ARGB values (BIGINT, 0..2^32-1). All stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pixelsift.model import CHANNELS, RANDOM_MAPS, transforms

OPAQUE = 0xFF000000
LOW = 0xFFFFFF


def channel(argb: Column, name: str) -> Column:
    return F.shiftrightunsigned(argb, CHANNELS[name]).bitwiseAND(F.lit(0xFF))


def opaque(colour: Column) -> Column:
    return colour.bitwiseAND(F.lit(LOW)).bitwiseOR(F.lit(OPAQUE))


def rgb(red: Column, green: Column, blue: Column) -> Column:
    """An opaque pixel of three 8-bit values."""
    return F.lit(OPAQUE) + red * 65536 + green * 256 + blue


def plane(argb: Column, bit: int) -> Column:
    """White where bit 0..31 of the pixel is set, else black."""
    if not 0 <= bit <= 31:
        raise ValueError("a pixel has bits 0 to 31")
    return F.when(F.shiftrightunsigned(argb, bit).bitwiseAND(F.lit(1)) == 1, F.lit(OPAQUE | LOW)).otherwise(F.lit(OPAQUE))


def full(argb: Column, name: str) -> Column:
    """One channel alone; that of alpha is shown as red."""
    if name == "alpha":
        return F.lit(OPAQUE) + channel(argb, "alpha") * 65536
    return F.lit(OPAQUE) + channel(argb, name) * (1 << CHANNELS[name])


def random_map(argb: Column, number: int) -> Column:
    """Component map: ((c * m * m) xor x) + a for each channel; sums carry into the next channel."""
    bm, ba, bx, gm, ga, gx, rm, ra, rx = RANDOM_MAPS[number]
    one = lambda name, m, a, x: (channel(argb, name) * (m * m)).bitwiseXOR(F.lit(x).cast("long")) + a
    return opaque(one("red", rm, ra, rx) * 65536 + one("green", gm, ga, gx) * 256 + one("blue", bm, ba, bx))


def gray(argb: Column) -> Column:
    same = (channel(argb, "red") == channel(argb, "green")) & (channel(argb, "green") == channel(argb, "blue"))
    return F.when(same, F.lit(OPAQUE | LOW)).otherwise(F.lit(OPAQUE))


def transform(argb: Column, index: int) -> Column:
    """Transform 0..41 of the catalogue."""
    _, kind, name, number, _ = transforms()[index]
    if kind == "original":
        return argb
    if kind == "invert":
        return opaque(argb.bitwiseXOR(F.lit(LOW)))
    if kind == "plane":
        return plane(argb, CHANNELS[name] + number)
    if kind == "full":
        return full(argb, name)
    return random_map(argb, number) if kind == "map" else gray(argb)


def luminance(argb: Column) -> Column:
    """Brightness over a white ground, 0..255."""
    alpha = channel(argb, "alpha")
    over = lambda name: F.floor((channel(argb, name) * alpha + (F.lit(255) - alpha) * 255) / 255)
    return F.shiftright(over("red") * 306 + over("green") * 601 + over("blue") * 117, 10)


def flatten_white(argb: Column) -> Column:
    """The pixel drawn over white, opaque; rounded to the nearest value."""
    alpha = channel(argb, "alpha")
    over = lambda name: F.floor((channel(argb, name) * alpha + (F.lit(255) - alpha) * 255 + 127) / 255)
    return rgb(over("red"), over("green"), over("blue"))


def argb_hex(argb: Column) -> Column:
    return F.concat(F.lit("#"), F.lpad(F.hex(argb), 8, "0"))


def channel_text(argb: Column) -> Column:
    """The four channels as numbers, for people."""
    return F.format_string("A %d, R %d, G %d, B %d", *[channel(argb, n).cast("int") for n in CHANNELS])


def bit_planes(argb: Column) -> Column:
    """The 32 bits in groups of eight: alpha, red, green, blue."""
    return F.regexp_replace(F.lpad(F.bin(argb), 32, "0"), "^(.{8})(.{8})(.{8})(.{8})$", "$1 $2 $3 $4")


def combine(first: Column, second: Column, mode: str) -> Column:
    """A blend of two pixels; only their low 24 bits matter, and the result is opaque."""
    a, b = first.bitwiseAND(F.lit(LOW)), second.bitwiseAND(F.lit(LOW))
    each = lambda f: rgb(*(f(channel(a, n), channel(b, n)) for n in ("red", "green", "blue")))
    whole = {
        "xor": lambda: a.bitwiseXOR(b), "or": lambda: a.bitwiseOR(b), "and": lambda: a.bitwiseAND(b),
        "add": lambda: a + b, "sub": lambda: F.pmod(a - b, F.lit(1 << 24)), "mul": lambda: F.pmod(a * b, F.lit(1 << 24)),
    }
    if mode in whole:
        return opaque(whole[mode]())
    parts = {
        "add_ch": lambda x, y: (x + y).bitwiseAND(F.lit(255)), "sub_ch": lambda x, y: F.pmod(x - y, F.lit(256)),
        "mul_ch": lambda x, y: (x * y).bitwiseAND(F.lit(255)), "light": F.greatest, "dark": F.least,
    }
    return each(parts[mode])
