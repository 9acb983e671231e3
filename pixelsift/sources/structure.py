"""Container structure of PNG, JPEG, GIF and BMP files as report rows; and the reader that feeds it.

Walkers never fail: whatever is truncated or odd becomes a warning. Files are rows of Spark's ``binaryFile``
source, one walker call each, so a job scales with the number of files; a report has at most
:data:`MOST` rows, so a hostile file can't flood it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelsift.model import MAX_FILE_BYTES, REPORT

MOST, TEXT, DUMP, PALETTE = 10_000, 4096, 512, 64


class Report:
    """Rows of (section number, section, kind, label, value), up to the bound."""

    def __init__(self):
        self.rows: list[tuple] = []
        self._no, self._name = -1, ""

    def section(self, name: str) -> None:
        self._no, self._name = self._no + 1, name

    def add(self, kind: str, label: str, value="") -> None:
        if len(self.rows) < MOST:
            self.rows.append((self._no, self._name, kind, label, str(value)[:TEXT]))

    def field(self, label: str, value) -> None:
        self.add("field", label, value)

    def warn(self, text: str) -> None:
        self.add("warn", text)

    def note(self, text: str) -> None:
        self.add("note", text)

    def dump(self, label: str, data: bytes) -> None:
        self.add("dump", label, data[:DUMP].hex())


def _le(d: bytes, at: int, n: int) -> int:
    return int.from_bytes(d[at : at + n], "little") if 0 <= at and at + n <= len(d) else 0


def _be(d: bytes, at: int, n: int) -> int:
    return int.from_bytes(d[at : at + n], "big") if 0 <= at and at + n <= len(d) else 0


def _text(b: bytes) -> str:
    return b[:TEXT].decode("latin-1")


def image_format(data: bytes) -> str:
    magic = {b"\x89PNG\r\n\x1a\n": "PNG", b"\xff\xd8\xff": "JPEG", b"GIF87a": "GIF", b"GIF89a": "GIF", b"BM": "BMP"}
    return next((name for m, name in magic.items() if data.startswith(m)), "UNKNOWN")


# PNG chunk types with what they hold.
PNG_CHUNKS = {
    "IHDR": "image header", "PLTE": "palette", "IDAT": "image data", "IEND": "end of image", "tRNS": "transparency", "gAMA": "gamma",
    "cHRM": "chromaticities", "sRGB": "standard RGB", "iCCP": "colour profile", "sBIT": "significant bits", "bKGD": "background",
    "hIST": "histogram", "pHYs": "pixel size", "sPLT": "suggested palette", "tIME": "modification time", "tEXt": "text",
    "zTXt": "compressed text", "iTXt": "international text", "eXIf": "Exif", "acTL": "animation control", "fcTL": "frame control", "fdAT": "frame data",
}
_PNG_DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}


def walk_png(d: bytes, r: Report) -> None:
    at, seen, colour = 8, [], None
    r.section("PNG chunks")
    while at < len(d):
        if at + 12 > len(d):
            r.warn(f"{len(d) - at} bytes at {at}: 12 are needed for a chunk")
            break
        n, kind = _be(d, at, 4), _text(d[at + 4 : at + 8])
        if at + 12 + n > len(d):
            r.warn(f"chunk {kind!r} at {at} declares {n} bytes but the file ends")
            break
        body, crc = d[at + 8 : at + 8 + n], _be(d, at + 8 + n, 4)
        r.section(f"{kind} at {at}")
        r.field("length", n)
        r.field("meaning", PNG_CHUNKS.get(kind, "unknown chunk"))
        if zlib.crc32(d[at + 4 : at + 8 + n]) != crc:
            r.warn(f"CRC is {crc:08x}, computed {zlib.crc32(d[at + 4 : at + 8 + n]):08x}")
        if not (kind.isascii() and kind.isalpha()):
            r.warn("chunk type isn't four letters")
        elif kind[2].islower():
            r.warn("the reserved bit of the chunk type is set")
        elif kind not in PNG_CHUNKS:
            r.note("critical unknown chunk" if kind[0].isupper() else "ancillary unknown chunk")
            if kind[1].islower():
                r.note("the chunk type is a private one")
            r.dump("data", body)
        if not seen and kind != "IHDR":
            r.warn("the first chunk isn't IHDR")
        if kind == "IHDR":
            if "IHDR" in seen:
                r.warn("more than one IHDR")
            if n != 13:
                r.warn(f"IHDR has {n} bytes, not 13")
            else:
                w, h, depth, colour, comp, filt, inter = _be(d, at + 8, 4), _be(d, at + 12, 4), *body[8:13]
                for label, v in (("width", w), ("height", h), ("bit depth", depth), ("colour type", colour), ("interlace", inter)):
                    r.field(label, v)
                if not w or not h:
                    r.warn("the image is empty")
                if depth not in _PNG_DEPTHS.get(colour, ()):
                    r.warn(f"bit depth {depth} isn't allowed with colour type {colour}")
                if comp or filt or inter > 1:
                    r.warn("unknown compression, filter or interlace method")
                if inter == 1 and h < 32:
                    r.note("interlaced though only a few rows high")
                bands = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour, 0)
                r.field("pixels", w * h)
                r.field("raw bytes", (w * h * bands * depth + 7) // 8)
                if w * h > 500_000_000:
                    r.warn("more pixels are declared than any real image has")
        elif kind == "PLTE":
            r.field("entries", n // 3)
            if n % 3 or n > 768:
                r.warn("palette length isn't a multiple of 3 up to 768")
            if "IDAT" in seen:
                r.warn("the palette comes after image data")
        elif kind == "tEXt":
            key, _, text = body.partition(b"\0")
            r.field(f"text {_text(key)}", _text(text))
        elif kind == "zTXt":
            key, _, rest = body.partition(b"\0")
            r.field(f"text {_text(key)}", _text(_inflate(rest[1:], r)))
        elif kind == "iTXt":
            key, _, rest = body.partition(b"\0")
            packed, rest = rest[:1] == b"\1", rest[2:]
            text = rest.split(b"\0", 2)[-1]
            r.field(f"text {_text(key)}", (_inflate(text, r) if packed else text)[:TEXT].decode("utf-8", "replace"))
        elif kind == "tIME" and n == 7:
            r.field("time", f"{_be(body, 0, 2):04d}-{body[2]:02d}-{body[3]:02d} {body[4]:02d}:{body[5]:02d}:{body[6]:02d}")
        elif kind == "pHYs" and n == 9:
            r.field("pixels per unit", f"{_be(body, 0, 4)} x {_be(body, 4, 4)}, unit {body[8]}")
        elif kind == "gAMA" and n == 4:
            r.field("gamma", _be(body, 0, 4) / 100000)
        elif kind == "tRNS":
            r.field("bytes of transparency", n)
            if n > 256:
                r.warn("more transparency than a palette has entries")
            r.dump("data", body)
        elif kind == "iCCP":
            r.field("profile", _text(body.partition(b"\0")[0]))
        elif kind == "bKGD":
            r.dump("background", body)
        elif kind == "acTL" and n == 8:
            r.field("animation frames", _be(body, 0, 4))
            r.field("animation plays", _be(body, 4, 4))
        elif kind == "IEND" and n:
            r.warn("the end chunk isn't empty")
        if kind == "IDAT" and seen and "IDAT" in seen and seen[-1] != "IDAT":
            r.warn("IDAT chunks aren't consecutive")
        seen.append(kind)
        at += 12 + n
        if kind == "IEND":
            break
    r.section("PNG summary")
    r.field("chunks", len(seen))
    r.field("IDAT chunks", seen.count("IDAT"))
    if "IDAT" not in seen:
        r.warn("no IDAT chunk")
    if colour == 3 and "PLTE" not in seen:
        r.warn("indexed colour without a palette")
    if "IEND" not in seen:
        r.warn("no IEND chunk")
    elif at < len(d):
        r.warn(f"{len(d) - at} bytes after IEND")
        r.dump("appended data", d[at:])


def _inflate(data: bytes, r: Report) -> bytes:
    try:
        return zlib.decompressobj().decompress(data, TEXT)
    except zlib.error:
        r.warn("compressed text can't be read")
        return b""


# JPEG markers with their names.
JPEG_MARKERS = {
    0xC4: "DHT", 0xC8: "JPG", 0xCC: "DAC", 0xD8: "SOI", 0xD9: "EOI", 0xDA: "SOS", 0xDB: "DQT", 0xDC: "DNL", 0xDD: "DRI", 0xDE: "DHP", 0xDF: "EXP", 0xFE: "COM", 0x01: "TEM",
} | {0xD0 + i: f"RST{i}" for i in range(8)} | {0xE0 + i: f"APP{i}" for i in range(16)} | {0xC0 + i: f"SOF{i}" for i in range(16) if i not in (4, 8, 12)}


def walk_jpeg(d: bytes, r: Report) -> None:
    at, ended, count = 2, False, 0
    r.section("JPEG segments")
    r.field("start", "SOI at 0")
    while at < len(d):
        if d[at] != 0xFF:
            end = d.find(b"\xff", at)
            end = len(d) if end < 0 else end
            r.warn(f"{end - at} bytes at {at} where a marker was due")
            at = end
            continue
        while at < len(d) and d[at] == 0xFF:
            at += 1
        if at >= len(d):
            break
        code = d[at]
        name = JPEG_MARKERS.get(code, f"0x{code:02x}")
        count += 1
        r.section(f"{name} at {at - 1}")
        at += 1
        if code == 0xD9:
            ended = True
            break
        if code == 0:
            r.warn("a stuffed zero outside a scan")
            continue
        if code == 0xD8:
            r.warn("a second start of image")
        elif 0xD0 <= code <= 0xD7:
            r.warn("a restart marker outside a scan")
        if code in (0x01, 0xD8) or 0xD0 <= code <= 0xD7:
            continue
        n = _be(d, at, 2)
        if at + 2 > len(d):
            r.warn("no length field")
            break
        if n < 2:
            r.warn(f"segment length {n} is below 2")
            at += 2
            continue
        body = d[at + 2 : at + n]
        r.field("length", n)
        if at + n > len(d):
            r.warn("the segment goes beyond the end of the file")
            break
        if name.startswith("SOF"):
            if len(body) < 6:
                r.warn("the frame header is too short")
            else:
                w, h, parts = _be(body, 3, 2), _be(body, 1, 2), body[5]
                for label, v in (("precision", body[0]), ("width", w), ("height", h), ("components", parts)):
                    r.field(label, v)
                if not w or not h:
                    r.warn("the frame is empty")
                if len(body) < 6 + 3 * parts:
                    r.warn("a component is missing")
        elif name == "APP0" and body.startswith(b"JFIF\0"):
            r.field("JFIF version", f"{_be(body, 5, 1)}.{_be(body, 6, 1):02d}")
        elif name == "APP1" and body.startswith(b"Exif\0\0"):
            r.field("Exif bytes", len(body) - 6)
        elif name == "COM":
            r.field("comment", _text(body))
        elif name == "DRI":
            r.field("restart interval", _be(body, 0, 2))
        elif name == "DQT":
            r.field("table", body[0] & 15 if body else "")
        elif name.startswith("APP"):
            r.dump("data", body)
        at += n
        if code == 0xDA:
            start = at
            while at + 1 < len(d) and not (d[at] == 0xFF and d[at + 1] != 0 and not 0xD0 <= d[at + 1] <= 0xD7):
                nxt = d.find(b"\xff", at + 1)
                at = len(d) if nxt < 0 else nxt
            r.field("scan bytes", at - start)
            if at + 1 >= len(d):
                r.warn("the scan isn't ended by a marker")
                break
    r.section("JPEG summary")
    r.field("markers", count)
    if not ended:
        r.warn("no EOI marker")
    elif at < len(d):
        r.warn(f"{len(d) - at} bytes after EOI")
        r.dump("appended data", d[at:])


def _sub_blocks(d: bytes, at: int) -> tuple[bytes, int, bool]:
    """Joined sub-blocks, where they end, and whether their end was there."""
    parts = []
    while at < len(d):
        n = d[at]
        if n == 0:
            return b"".join(parts), at + 1, True
        parts.append(d[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(parts), len(d), False


def _gif_palette(d: bytes, at: int, n: int, r: Report, label: str) -> None:
    colours = [d[at + 3 * i : at + 3 * i + 3].hex() for i in range(n)]
    for i, c in enumerate(colours[:PALETTE]):
        r.add("line", f"{label} {i}", c)
    same = sum(a == b for a, b in zip(colours, colours[1:]))
    if same:
        r.note(f"{same} entries of the {label} equal the one before")


def walk_gif(d: bytes, r: Report) -> None:
    r.section("GIF header")
    r.field("version", _text(d[3:6]))
    if len(d) < 13:
        r.warn("the logical screen descriptor is cut off")
        return
    w, h, flags = _le(d, 6, 2), _le(d, 8, 2), d[10]
    r.field("width", w)
    r.field("height", h)
    r.field("background", d[11])
    at = 13
    if flags & 0x80:
        n = 2 << (flags & 7)
        r.field("global colours", n)
        if at + 3 * n > len(d):
            r.warn("the global colour table is cut off")
            return
        _gif_palette(d, at, n, r, "global colour")
        at += 3 * n
    frames, ended = 0, False
    while at < len(d):
        code, begin = d[at], at
        if code == 0x3B:
            ended, at = True, at + 1
            break
        if code == 0x2C:
            r.section(f"frame {frames} at {begin}")
            if at + 10 > len(d):
                r.warn("the image descriptor is cut off")
                break
            x, y, fw, fh, f = _le(d, at + 1, 2), _le(d, at + 3, 2), _le(d, at + 5, 2), _le(d, at + 7, 2), d[at + 9]
            r.field("area", f"{fw}x{fh} at {x},{y}")
            if x + fw > w or y + fh > h:
                r.warn("the frame lies outside the screen")
            if f & 0x40:
                r.note("interlaced")
            if f & 0x18:
                r.warn("reserved bits are set")
            at += 10
            if f & 0x80:
                n = 2 << (f & 7)
                r.field("local colours", n)
                if at + 3 * n > len(d):
                    r.warn("the local colour table is cut off")
                    break
                _gif_palette(d, at, n, r, "local colour")
                at += 3 * n
            if at >= len(d):
                r.warn("no LZW code size")
                break
            r.field("LZW code size", d[at])
            data, at, whole = _sub_blocks(d, at + 1)
            r.field("compressed bytes", len(data))
            if not whole:
                r.warn("the frame's data is cut off")
            frames += 1
        elif code == 0x21:
            label = _le(d, at + 1, 1)
            body, end, whole = _sub_blocks(d, at + 2)
            name = {0xF9: "graphic control", 0xFE: "comment", 0x01: "plain text", 0xFF: "application"}.get(label, f"unknown extension 0x{label:02x}")
            r.section(f"{name} at {begin}")
            if label == 0xF9 and len(body) >= 4:
                r.field("delay", f"{_le(body, 1, 2)} hundredths")
                r.field("disposal", body[0] >> 2 & 7)
                if body[0] & 1:
                    r.field("transparent index", body[3])
            elif label == 0xFE:
                r.field("comment", _text(body))
                r.dump("comment bytes", body)
            elif label == 0x01:
                r.field("text", _text(body[12:]))
            elif label == 0xFF:
                r.field("application", _text(body[:11]))
                r.field("data bytes", max(0, len(body) - 11))
            else:
                r.warn("unknown extension")
                r.dump("data", body)
            if not whole:
                r.warn("the extension is cut off")
            at = end
        else:
            r.section(f"unknown block at {begin}")
            r.warn(f"unknown block 0x{code:02x}")
            break
    r.section("GIF summary")
    r.field("frames", frames)
    if not ended:
        r.warn("no trailer")
    elif at < len(d):
        r.warn(f"{len(d) - at} bytes after the trailer")
        r.dump("appended data", d[at:])


# BMP compression methods.
BMP_METHODS = {0: "none", 1: "RLE8", 2: "RLE4", 3: "bit fields", 4: "JPEG", 5: "PNG", 6: "alpha bit fields"}


def walk_bmp(d: bytes, r: Report) -> None:
    r.section("BMP file header")
    if len(d) < 14:
        r.warn("the file header is cut off")
        return
    declared, offset = _le(d, 2, 4), _le(d, 10, 4)
    r.field("declared size", declared)
    r.field("pixel offset", offset)
    if declared != len(d):
        r.note(f"the file has {len(d)} bytes")
    if offset < 14:
        r.warn("the pixel offset lies inside the file header")
    r.section("BMP info header")
    if len(d) < 18:
        r.warn("the info header is cut off")
        return
    size = _le(d, 14, 4)
    r.field("header size", size)
    old = size == 12
    if len(d) < 14 + size or size < 12:
        r.warn("the info header is cut off")
        return
    signed = lambda v: v - (1 << 32) if v >> 31 else v
    w, h = (_le(d, 18, 2), _le(d, 20, 2)) if old else (signed(_le(d, 18, 4)), signed(_le(d, 22, 4)))
    planes, bits = (_le(d, 22, 2), _le(d, 24, 2)) if old else (_le(d, 26, 2), _le(d, 28, 2))
    method, used = (0, 0) if old or size < 40 else (_le(d, 30, 4), _le(d, 46, 4))
    for label, v in (("width", w), ("height", h), ("planes", planes), ("bits per pixel", bits), ("compression", BMP_METHODS.get(method, method)), ("colours used", used)):
        r.field(label, v)
    if planes != 1:
        r.warn("planes isn't 1")
    if w <= 0 or h == 0:
        r.warn("the image is empty")
    if bits not in (1, 4, 8, 16, 24, 32):
        r.warn(f"{bits} bits per pixel are unusual")
    start = 14 + size + (12 if method == 3 and size == 40 else 16 if method == 6 and size == 40 else 0)
    entry = 3 if old else 4
    colours = (used or (1 << bits if bits <= 8 else 0)) if bits else 0
    end = start + entry * colours
    if colours:
        r.section("BMP colour table")
        r.field("entries", colours)
        if end > len(d) or end > offset:
            r.warn("the colour table overlaps the pixels or the file ends inside")
        for i in range(min(colours, PALETTE, max(0, (len(d) - start) // entry))):
            b, g, red = d[start + entry * i : start + entry * i + 3]
            r.add("line", f"colour {i}", f"{red:02x}{g:02x}{b:02x}")
    if offset > end:
        r.note(f"{offset - end} bytes between the headers and the pixels")
        r.dump("gap", d[end:offset])
    stride = (abs(w) * bits + 31) // 32 * 4
    r.section("BMP pixels")
    r.field("stride", stride)
    if method in (0, 3, 6):
        need = offset + stride * abs(h)
        if need > len(d):
            r.warn(f"pixel data is cut off, {need - len(d)} bytes are missing")
        elif need < len(d):
            r.warn(f"{len(d) - need} bytes after the pixels")
            r.dump("appended data", d[need:])
    else:
        r.note(f"compressed with {BMP_METHODS.get(method, method)}")


def analyse(data: bytes) -> list[tuple]:
    """Rows of the report on one file."""
    r = Report()
    kind = image_format(data)
    r.section("File")
    r.field("size", len(data))
    r.field("format", kind)
    r.field("sha256", hashlib.sha256(data).hexdigest())
    r.dump("first bytes", data[:64])
    walker = {"PNG": walk_png, "JPEG": walk_jpeg, "GIF": walk_gif, "BMP": walk_bmp}.get(kind)
    if walker:
        walker(data, r)
    else:
        r.note("no structure is known for this format")
    return r.rows


def report(files: DataFrame) -> DataFrame:
    """Report rows of a ``binaryFile`` DataFrame (path, length, content); empty and oversized files get one warning."""

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = analyse(data) if data else [(0, "File", "warn", "the file is empty or too large", "")]
                cols = list(zip(*rows, strict=True))
                n = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(range(n), pa.int32()), pa.array(cols[0], pa.int32()), *[pa.array(c, pa.string()) for c in cols[1:]]], names=["path", "seq", "section_no", "section", "kind", "label", "value"])

    content = F.when(F.octet_length("content") <= MAX_FILE_BYTES, F.col("content"))
    return files.select("path", content.alias("content")).mapInArrow(run, REPORT)


def as_text(rows: DataFrame) -> DataFrame:
    """One line of text per report row, for ``write.text``; order them by path and seq."""
    return rows.select("path", "seq", F.when(F.col("kind") == "warn", F.concat(F.lit("! "), "label")).when(F.col("value") == "", F.col("label")).otherwise(F.concat("label", F.lit(": "), "value")).alias("line"))


def read_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path).where((F.col("length") > 0) & (F.col("length") <= MAX_FILE_BYTES))
