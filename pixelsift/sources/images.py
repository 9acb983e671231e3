"""Image files to pixels and back, in numpy: PNG, BMP, GIF, TIFF and sequential JPEG; other JPEG files by way of Spark's
own image source.

Headers are read before anything is decoded, so an image that declares too many pixels costs nothing. One
file is one row; frames of a GIF are rows of their own, as stored (nothing is composed).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelsift.functions import jpeg
from pixelsift.model import MAX_PIXELS
from pixelsift.sources.structure import image_format

DECODED = "path string, frame int, width int, height int, has_alpha boolean, pixels binary, indices binary, palette array<long>, error string"


class Image:
    """width by height uint32 ARGB, with palette and indices where the file has them."""

    def __init__(self, argb: np.ndarray, has_alpha: bool, indices: np.ndarray | None = None, palette: np.ndarray | None = None):
        self.argb, self.has_alpha, self.indices, self.palette = argb.astype(np.uint32), has_alpha, indices, palette


def _pack(a, r, g, b) -> np.ndarray:
    a, r, g, b = (np.asarray(v, np.uint32) for v in (a, r, g, b))
    return a << np.uint32(24) | r << np.uint32(16) | g << np.uint32(8) | b


def check_size(width: int, height: int) -> None:
    if width <= 0 or height <= 0 or width * height > MAX_PIXELS:
        raise ValueError(f"{width}x{height} pixels are none or too many")


def gray_to_srgb() -> np.ndarray:
    """Linear gray levels as sRGB levels."""
    v = np.arange(256) / 255
    return np.rint(255 * np.where(v <= 0.0031308, 12.92 * v, 1.055 * v ** (1 / 2.4) - 0.055)).astype(np.uint32)


def _unfilter(raw: bytes, rows: int, stride: int, bpp: int) -> tuple[np.ndarray, int]:
    out = np.zeros((rows, stride), np.uint8)
    at, above = 0, np.zeros(stride, np.uint8)
    for y in range(rows):
        if at + 1 + stride > len(raw):
            raise ValueError("the pixel data is cut off")
        kind, line = raw[at], np.frombuffer(raw, np.uint8, stride, at + 1).copy()
        at += 1 + stride
        if kind == 2:
            line += above
        elif kind == 1:
            for c in range(bpp):
                line[c::bpp] = np.cumsum(line[c::bpp], dtype=np.uint64).astype(np.uint8)
        elif kind in (3, 4):
            cur, up = line.tolist(), above.tolist()
            for i in range(stride):
                left = cur[i - bpp] if i >= bpp else 0
                if kind == 3:
                    guess = (left + up[i]) >> 1
                else:
                    corner = up[i - bpp] if i >= bpp else 0
                    p = left + up[i] - corner
                    guess = min((left, up[i], corner), key=lambda v: abs(p - v))
                cur[i] = (cur[i] + guess) & 255
            line = np.array(cur, np.uint8)
        elif kind:
            raise ValueError(f"unknown filter {kind}")
        out[y] = above = line
    return out, at


# Passes of PNG interlacing as (x start, y start, x step, y step).
_ADAM7 = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def decode_png(d: bytes) -> Image:
    at, idat, palette, trns, head = 8, [], None, None, None
    while at + 12 <= len(d):
        n, kind = int.from_bytes(d[at : at + 4], "big"), d[at + 4 : at + 8]
        body = d[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
            check_size(*head[:2])
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.uint32)
        elif kind == b"tRNS":
            trns = body
        elif kind == b"IDAT":
            idat.append(body)
        elif kind == b"IEND":
            break
        at += 12 + n
    if head is None:
        raise ValueError("no IHDR")
    w, h, depth, colour, _, _, interlaced = head
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    bpp = max(1, channels * depth // 8)
    limit = (h + 8) * ((w * channels * depth + 7) // 8 + 9) * 2 + 64
    raw = zlib.decompressobj().decompress(b"".join(idat), limit)

    def samples(rows: int, cols: int, data: bytes) -> tuple[np.ndarray, int]:
        stride = (cols * channels * depth + 7) // 8
        lines, used = _unfilter(data, rows, stride, bpp)
        if depth == 16:
            got = lines.reshape(rows, -1, 2)
            flat = got[:, :, 0].astype(np.uint32) << 8 | got[:, :, 1]
        elif depth == 8:
            flat = lines.astype(np.uint32)
        else:
            bits = np.unpackbits(lines, axis=1).reshape(rows, -1, depth)
            flat = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(2).astype(np.uint32)
        return flat[:, : cols * channels].reshape(rows, cols, channels), used

    if interlaced:
        px, pos = np.zeros((h, w, channels), np.uint32), 0
        for x0, y0, dx, dy in _ADAM7:
            rows, cols = max(0, -(-(h - y0) // dy)), max(0, -(-(w - x0) // dx))
            if rows and cols:
                got, used = samples(rows, cols, raw[pos:])
                px[y0::dy, x0::dx] = got
                pos += used
    else:
        px, _ = samples(h, w, raw)
    key = None
    if trns and colour in (0, 2):
        key = np.all(px == np.array(struct.unpack(f">{channels}H", trns[: 2 * channels]), np.uint32), axis=2)
    if colour == 3:
        if palette is None:
            raise ValueError("no palette")
        alpha = np.full(len(palette), 255, np.uint32)
        if trns:
            alpha[: len(trns)] = np.frombuffer(trns, np.uint8)[: len(palette)]
        table = _pack(alpha, *palette.T)
        index = np.minimum(px[:, :, 0], len(table) - 1)
        return Image(table[index], trns is not None, index.astype(np.uint8), table)
    if depth == 16:
        px = (px * 255 + 32767) // 65535
    elif depth < 8:
        px = px * (255 // ((1 << depth) - 1))
    if colour in (0, 4):
        level = gray_to_srgb()[px[:, :, 0]] if depth >= 8 else px[:, :, 0]
        r = g = b = level
    else:
        r, g, b = px[:, :, 0], px[:, :, 1], px[:, :, 2]
    alpha = px[:, :, -1] if colour in (4, 6) else np.where(key, 0, 255) if key is not None else 255
    return Image(_pack(alpha, r, g, b), colour in (4, 6) or key is not None)


def decode_bmp(d: bytes) -> Image:
    offset, size = int.from_bytes(d[10:14], "little"), int.from_bytes(d[14:18], "little")
    old = size == 12
    w, h = struct.unpack("<HH" if old else "<ii", d[18 : 22 if old else 26])
    bits = int.from_bytes(d[24:26] if old else d[28:30], "little")
    method = 0 if old else int.from_bytes(d[30:34], "little")
    check_size(w, abs(h))
    if method not in (0, 3):
        raise ValueError(f"compression {method} isn't decoded")
    stride = (w * bits + 31) // 32 * 4
    if offset + stride * abs(h) > len(d):
        raise ValueError("the pixel data is cut off")
    lines = np.frombuffer(d, np.uint8, stride * abs(h), offset).reshape(abs(h), stride)
    if h > 0:
        lines = lines[::-1]
    if bits <= 8:
        entry, used = (3, 0) if old else (4, int.from_bytes(d[46:50], "little"))
        n = used or 1 << bits
        table = np.frombuffer(d, np.uint8, n * entry, 14 + size).reshape(n, entry).astype(np.uint32)
        palette = _pack(255, table[:, 2], table[:, 1], table[:, 0])
        unpacked = np.unpackbits(lines, axis=1).reshape(abs(h), -1, bits)[:, :w]
        index = np.minimum((unpacked * (1 << np.arange(bits - 1, -1, -1))).sum(2), n - 1).astype(np.uint8)
        return Image(palette[index], False, index, palette)
    if bits == 24:
        px = lines[:, : 3 * w].reshape(abs(h), w, 3)
        return Image(_pack(255, px[:, :, 2], px[:, :, 1], px[:, :, 0]), False)
    value = lines[:, : w * bits // 8].copy().view("<u2" if bits == 16 else "<u4").astype(np.uint32)
    masks = struct.unpack("<III", d[54:66]) if method == 3 else (0x7C00, 0x3E0, 0x1F) if bits == 16 else (0xFF0000, 0xFF00, 0xFF)

    def part(mask: int) -> np.ndarray:
        shift = (mask & -mask).bit_length() - 1
        top = mask >> shift
        return ((value & np.uint32(mask)) >> np.uint32(shift)) * np.uint32(255) // np.uint32(top)

    return Image(_pack(255, *map(part, masks)), False)


def _lzw(data: bytes, size: int, want: int) -> np.ndarray:
    clear, end = 1 << size, (1 << size) + 1
    table: list[bytes] = []
    out, got, bits, n, at, width, before = [], 0, 0, 0, 0, size + 1, None
    while got < want:
        while n < width and at < len(data):
            bits |= data[at] << n
            n += 8
            at += 1
        if n < width:
            break
        code, bits, n = bits & (1 << width) - 1, bits >> width, n - width
        if code == clear:
            table, width, before = [bytes([i]) for i in range(clear)] + [b"", b""], size + 1, None
            continue
        if code == end or not table:
            break
        if before is None:
            word = table[code] if code < len(table) else b""
        else:
            word = table[code] if code < len(table) else before + before[:1]
            if len(table) < 4096:
                table.append(before + word[:1])
                if len(table) == 1 << width and width < 12:
                    width += 1
        out.append(word)
        got += len(word)
        before = word
    return np.frombuffer((b"".join(out) + bytes(want))[:want], np.uint8)


def gif_frames(d: bytes, first: int = 0, count: int | None = None) -> list[Image]:
    """The stored images of ``count`` frames (all) from ``first`` on; others are passed over."""
    flags, at, common = d[10], 13, None
    check_size(int.from_bytes(d[6:8], "little"), int.from_bytes(d[8:10], "little"))

    def table(at: int, n: int) -> np.ndarray:
        c = np.frombuffer(d, np.uint8, 3 * n, at).reshape(n, 3)
        return _pack(255, *c.T)

    if flags & 0x80:
        n = 2 << (flags & 7)
        common = table(at, n)
        at += 3 * n
    frames, clear, no = [], None, -1
    while at < len(d) and d[at] != 0x3B and (count is None or len(frames) < count):
        if d[at] == 0x21:
            if d[at + 1] == 0xF9:
                clear = d[at + 6] if d[at + 3] & 1 else None
            at += 2
            while at < len(d) and d[at]:
                at += 1 + d[at]
            at += 1
        elif d[at] == 0x2C:
            _, _, w, h, f = struct.unpack("<HHHHB", d[at + 1 : at + 10])
            check_size(w, h)
            at += 10
            colours = common
            if f & 0x80:
                n = 2 << (f & 7)
                colours = table(at, n)
                at += 3 * n
            if colours is None:
                raise ValueError("no colour table")
            size, at, parts = d[at], at + 1, []
            while at < len(d) and d[at]:
                parts.append(d[at + 1 : at + 1 + d[at]])
                at += 1 + d[at]
            at += 1
            no += 1
            if no < first:
                clear = None
                continue
            index = np.minimum(_lzw(b"".join(parts), size, w * h), len(colours) - 1).reshape(h, w)
            if f & 0x40:
                order = [y for start, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(start, h, step)]
                straight = np.empty_like(index)
                straight[order] = index
                index = straight
            palette = colours.copy()
            if clear is not None and clear < len(palette):
                palette[clear] &= np.uint32(0xFFFFFF)
            frames.append(Image(palette[index], clear is not None, index.astype(np.uint8), palette))
            clear = None
        else:
            break
    if not frames:
        raise ValueError(f"no frame {first}" if first else "no frame")
    return frames


def decode_jpeg(d: bytes) -> Image:
    levels = jpeg.decode(d, check_size).astype(np.uint32)
    if levels.shape[2] == 1:
        levels = gray_to_srgb()[levels]
    return Image(_pack(255, levels[:, :, 0], levels[:, :, levels.shape[2] // 2], levels[:, :, -1]), False)


def _unpacked_bits(d: bytes) -> bytes:
    """Runs of bytes (PackBits) as they were."""
    out, at = bytearray(), 0
    while at + 1 < len(d):
        n, at = d[at], at + 1
        if n < 128:
            out += d[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += d[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def tiff_frames(d: bytes, first: int = 0, count: int | None = None) -> list[Image]:
    """Pages in strips of 8-bit samples (gray, RGB, palette, with or without alpha), plain, deflated or as PackBits."""
    end = "<" if d[:2] == b"II" else ">"
    (at,) = struct.unpack_from(end + "I", d, 4)
    pages, seen, no = [], set(), 0
    while at and at not in seen and (count is None or len(pages) < count):
        seen.add(at)
        (n,) = struct.unpack_from(end + "H", d, at)
        tags: dict[int, tuple] = {}
        for i in range(n):
            tag, kind, many, _ = struct.unpack_from(end + "HHII", d, at + 2 + 12 * i)
            letter = {1: "B", 3: "H", 4: "I"}.get(kind)
            if letter:
                place = at + 10 + 12 * i
                if struct.calcsize(letter) * many > 4:
                    (place,) = struct.unpack_from(end + "I", d, place)
                if place + struct.calcsize(letter) * many > len(d):
                    raise ValueError("the pixel data is cut off")
                tags[tag] = struct.unpack_from(f"{end}{many}{letter}", d, place)
        (at,) = struct.unpack_from(end + "I", d, at + 2 + 12 * n)
        no += 1
        if no > first:
            pages.append(_tiff_page(d, tags, end))
    if not pages:
        raise ValueError(f"no frame {first}" if first else "no frame")
    return pages


def _tiff_page(d: bytes, tags: dict[int, tuple], end: str) -> Image:
    one = lambda tag, default: tags.get(tag, (default,))[0]
    w, h, samples, method, colour = one(256, 0), one(257, 0), one(277, 1), one(259, 1), one(262, 1)
    check_size(w, h)
    if set(tags.get(258, (1,))) != {8} or 273 not in tags or one(284, 1) != 1 or colour not in (0, 1, 2, 3) or samples < (3 if colour == 2 else 1):
        raise ValueError("only TIFF strips of 8-bit samples, gray, RGB or palette, are decoded")
    unpack = {1: bytes, 8: zlib.decompress, 32946: zlib.decompress, 32773: _unpacked_bits}.get(method)
    if unpack is None:
        raise ValueError(f"compression {method} isn't decoded")
    raw = b"".join(unpack(d[a : a + n]) for a, n in zip(tags[273], tags[279], strict=True))
    if len(raw) < w * h * samples:
        raise ValueError("the pixel data is cut off")
    px = np.frombuffer(raw, np.uint8, w * h * samples).reshape(h, w, samples)
    if one(317, 1) == 2:
        px = np.cumsum(px, 1, dtype=np.uint64).astype(np.uint8)
    elif one(317, 1) != 1:
        raise ValueError("an unknown predictor")
    extra = samples - (3 if colour == 2 else 1)
    alpha = px[:, :, -extra] if extra and one(338, 0) in (1, 2) else None
    if colour == 3:
        table = np.array(tags[320]).reshape(3, -1) >> 8
        palette, index = _pack(255, *table), px[:, :, 0]
        return Image(palette[index], False, index.copy(), palette)
    if colour < 2:
        gray = gray_to_srgb()[px[:, :, 0] if colour else 255 - px[:, :, 0]]
        return Image(_pack(255 if alpha is None else alpha, gray, gray, gray), alpha is not None)
    return Image(_pack(255 if alpha is None else alpha, px[:, :, 0], px[:, :, 1], px[:, :, 2]), alpha is not None)


def decode(data: bytes, first: int = 0, count: int | None = None) -> list[Image]:
    """``count`` frames (all) from ``first`` on; a file without frame ``first`` is an error."""
    kind = image_format(data)
    if kind == "GIF":
        return gif_frames(data, first, count)
    if data[:4] in (b"II*\0", b"MM\0*"):
        return tiff_frames(data, first, count)
    if first and kind in ("PNG", "BMP", "JPEG"):
        raise ValueError(f"no frame {first}")
    if kind == "JPEG":
        return [decode_jpeg(data)]
    if kind == "PNG":
        return [decode_png(data)]
    if kind == "BMP":
        return [decode_bmp(data)]
    raise ValueError(f"format {kind} isn't decoded here")


def read_images(files: DataFrame, first: int = 0, count: int | None = None) -> DataFrame:
    """Packed frames of a ``binaryFile`` DataFrame, ``count`` of each file (all) from ``first`` on; what can't be decoded, or
    has no such frame, is a row with an error."""
    if first < 0 or (count is not None and count < 1):
        raise ValueError("frames are counted from 0, and at least one is read")

    def run(batches: Iterable[pa.RecordBatch]):
        names = ["path", "frame", "width", "height", "has_alpha", "pixels", "indices", "palette", "error"]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.string()]
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    frames = decode(data, first, count)
                    rows = [(path, first + i, f.argb.shape[1], f.argb.shape[0], f.has_alpha, f.argb.astype(">u4").tobytes(), None if f.indices is None else f.indices.tobytes(), None if f.palette is None else f.palette.astype(np.int64).tolist(), None) for i, f in enumerate(frames)]
                except (ValueError, KeyError, IndexError, TypeError, struct.error, zlib.error) as e:
                    rows = [(path, first, None, None, None, None, None, None, str(e))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return files.select("path", "content").mapInArrow(run, DECODED)


def read_jpegs(spark: SparkSession, path: str) -> DataFrame:
    """JPEG pixels (BGR, as Spark's image source gives them) in the packed layout."""

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            made = []
            for w, h, n, data in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 4)), strict=True):
                c = np.frombuffer(data, np.uint8).reshape(h, w, n)
                made.append(_pack(255, c[:, :, min(2, n - 1)], c[:, :, min(1, n - 1)], c[:, :, 0]).astype(">u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([False] * len(made)), pa.array(made, pa.binary())], names=["image_id", "width", "height", "has_alpha", "pixels"])

    rows = spark.read.format("image").option("dropInvalid", True).load(path).select("image.origin", "image.width", "image.height", "image.nChannels", "image.data")
    return rows.mapInArrow(run, "image_id string, width int, height int, has_alpha boolean, pixels binary")


def to_long(packed: DataFrame) -> DataFrame:
    """Packed images as long pixels."""

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            for image, w, h, data in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                argb = np.frombuffer(data, ">u4").astype(np.int64)
                step = max(1, (1 << 18) // max(1, w))
                for y in range(0, h, step):
                    rows = min(step, h - y)
                    n = rows * w
                    yield pa.RecordBatch.from_arrays([pa.array([image] * n), pa.array(np.tile(np.arange(w, dtype=np.int32), rows)), pa.array(np.repeat(np.arange(y, y + rows, dtype=np.int32), w)), pa.array(argb[y * w : y * w + n])], names=["image_id", "x", "y", "argb"])

    return packed.select("image_id", "width", "height", "pixels").mapInArrow(run, "image_id string, x int, y int, argb long")


def to_packed(px: DataFrame, has_alpha: bool = True) -> DataFrame:
    """Long pixels as packed images; cells that are missing are 0. Pixels are gathered to rows of their image in parallel,
    rows to images; a packed image is one row."""

    def lines(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            made = []
            for i in range(batch.num_rows):
                x = batch.column(2)[i].values.to_numpy(zero_copy_only=False)
                line = np.zeros(int(x.max()) + 1, ">u4")
                line[x] = batch.column(3)[i].values.to_numpy(zero_copy_only=False)
                made.append(line.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], names=["image_id", "y", "line"])

    def whole(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            for image, w, h, rows in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                out = np.zeros((h, w), ">u4")
                for row in rows:
                    line = np.frombuffer(row["line"], ">u4")
                    out[row["y"], : len(line)] = line
                yield pa.RecordBatch.from_arrays([pa.array([image], pa.string()), pa.array([w], pa.int32()), pa.array([h], pa.int32()), pa.array([has_alpha]), pa.array([out.tobytes()], pa.binary())], names=["image_id", "width", "height", "has_alpha", "pixels"])

    gathered = px.groupBy("image_id", "y").agg(F.collect_list("x").alias("xs"), F.collect_list("argb").alias("values")).select("image_id", "y", "xs", "values")
    packed = gathered.mapInArrow(lines, "image_id string, y int, line binary")
    images = packed.groupBy("image_id").agg((F.max(F.octet_length("line")) / 4).cast("int").alias("w"), (F.max("y") + 1).alias("h"), F.collect_list(F.struct("y", "line")).alias("lines"))
    return images.mapInArrow(whole, "image_id string, width int, height int, has_alpha boolean, pixels binary")
