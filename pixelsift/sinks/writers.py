"""Pixels and payloads to files. Each task writes beside its target and moves the finished file into place."""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelsift.functions import jpeg

#: Extensions of the formats that can be written, in order of preference.
WRITABLE = ("png", "bmp", "jpg", "gif", "tif")


def format_of(name: str) -> str:
    """The format of a file name; png if it has none."""
    extension = os.path.splitext(name)[1].lstrip(".").lower()
    return {"jpg": "jpeg", "tif": "tiff", "": "png"}.get(extension, extension)


def flatten(argb: np.ndarray) -> np.ndarray:
    """Channels red, green, blue over white."""
    a = (argb >> np.uint32(24)).astype(np.uint32)
    return np.stack([(((argb >> np.uint32(s)) & 255) * a + (255 - a) * 255 + 127) // 255 for s in (16, 8, 0)], 2).astype(np.uint8)


def encode_png(argb: np.ndarray, has_alpha: bool) -> bytes:
    h, w = argb.shape
    parts = [(argb >> np.uint32(s)) & 255 for s in ((16, 8, 0, 24) if has_alpha else (16, 8, 0))]
    lines = np.stack(parts, 2).astype(np.uint8).reshape(h, -1)
    raw = np.concatenate([np.zeros((h, 1), np.uint8), lines], 1).tobytes()

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6 if has_alpha else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def encode_bmp(argb: np.ndarray) -> bytes:
    """24 bits a pixel; the format has no alpha, so the image is drawn over white."""
    h, w = argb.shape
    stride = (3 * w + 3) // 4 * 4
    lines = np.zeros((h, stride), np.uint8)
    lines[:, : 3 * w] = flatten(argb)[:, :, ::-1].reshape(h, -1)
    return struct.pack("<2sIHHI", b"BM", 54 + stride * h, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, stride * h, 2835, 2835, 0, 0) + lines[::-1].tobytes()


def encode_jpeg(argb: np.ndarray, quality: int = 75) -> bytes:
    """The format has no alpha, so the image is drawn over white."""
    return jpeg.encode(flatten(argb), quality)


def _colours(argb: np.ndarray) -> tuple[np.ndarray, np.ndarray, int | None]:
    """Indices, at most 256 colours and the transparent one: exact if there are so few, else the nearest of 6 x 7 x 6 levels."""
    clear = argb >> np.uint32(24) < 128
    rgb = np.where(clear, 0, argb & np.uint32(0xFFFFFF))
    table, index = np.unique(rgb[~clear], return_inverse=True)
    if len(table) + bool(clear.any()) > 256:
        levels = np.array([6, 7, 6])
        steps = [((rgb >> np.uint32(s)) & 255).astype(np.int64) * (n - 1) for s, n in zip((16, 8, 0), levels, strict=True)]
        r, g, b = ((v + 127) // 255 for v in steps)
        grid = np.indices(levels).reshape(3, -1).T * 255 // (levels - 1)
        table, index = grid[:, 0] << 16 | grid[:, 1] << 8 | grid[:, 2], ((r * 7 + g) * 6 + b)[~clear]
    out = np.full(argb.shape, len(table), np.int64)
    out[~clear] = index
    return out, table.astype(np.int64), len(table) if clear.any() else None


def _lzw(index: bytes, size: int) -> bytes:
    clear = 1 << size
    table = {bytes([i]): i for i in range(clear)}
    width, out, now, n, word = size + 1, bytearray(), clear, size + 1, b""

    def put(code: int) -> None:
        nonlocal now, n
        now |= code << n
        n += width
        while n >= 8:
            out.append(now & 255)
            now, n = now >> 8, n - 8

    for i in range(len(index)):
        longer = word + index[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        following = len(table) + 2
        if following < 4096:
            table[longer] = following
            width += following == 1 << width
        else:
            put(clear)
            table, width = {bytes([i]): i for i in range(clear)}, size + 1
        word = longer[-1:]
    put(table[word])
    width += len(table) + 2 == 1 << width and width < 12  # readers add a word for the last code, too
    put(clear + 1)
    return bytes(out) + bytes([now & 255] * (n > 0))


def encode_gif(argb: np.ndarray) -> bytes:
    """One frame; pixels of less than half opacity are transparent."""
    h, w = argb.shape
    if max(h, w) > 65535:
        raise ValueError("a GIF has at most 65535 rows and columns")
    index, table, clear = _colours(argb)
    size = max(2, int(len(table) + (clear is not None) - 1).bit_length())
    palette = np.zeros((1 << size, 3), np.uint8)
    palette[: len(table)] = np.stack([table >> s & 255 for s in (16, 8, 0)], 1)
    control = b"" if clear is None else struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1, 0, clear, 0)
    data = _lzw(index.astype(np.uint8).tobytes(), size)
    blocks = b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255))
    return b"GIF89a" + struct.pack("<HHBBB", w, h, 0xF0 | size - 1, 0, 0) + palette.tobytes() + control + struct.pack("<BHHHHBB", 0x2C, 0, 0, w, h, 0, size) + blocks + b"\0;"


def encode_tiff(argb: np.ndarray, has_alpha: bool) -> bytes:
    """One deflated strip of 8-bit samples."""
    h, w = argb.shape
    n = 4 if has_alpha else 3
    data = zlib.compress(np.stack([(argb >> np.uint32(s)) & 255 for s in (16, 8, 0, 24)[:n]], 2).astype(np.uint8).tobytes())
    tags = [(256, 4, w), (257, 4, h), (258, 3, None), (259, 3, 8), (262, 3, 2), (273, 4, None), (277, 3, n), (278, 4, h), (279, 4, len(data)), (284, 3, 1), *[(338, 3, 2)] * has_alpha]
    depths = 8 + 2 + 12 * len(tags) + 4
    where = {258: depths, 273: depths + 2 * n}
    entries = b"".join(struct.pack("<HHII", tag, kind, n if tag == 258 else 1, where.get(tag, value)) for tag, kind, value in tags)
    return b"II*\0" + struct.pack("<IH", 8, len(tags)) + entries + bytes(4) + struct.pack(f"<{n}H", *[8] * n) + data


def encode(argb: np.ndarray, has_alpha: bool, kind: str) -> bytes:
    if kind in ("png", "tiff"):
        return {"png": encode_png, "tiff": encode_tiff}[kind](argb, has_alpha)
    if kind in ("bmp", "jpeg", "gif"):
        return {"bmp": encode_bmp, "jpeg": encode_jpeg, "gif": encode_gif}[kind](argb)
    raise ValueError(f"format {kind} can't be written")


def encoded(packed: DataFrame, kind: str = "png") -> DataFrame:
    """Packed images as file contents: (image_id, content)."""

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            out = [encode(np.frombuffer(d, ">u4").astype(np.uint32).reshape(h, w), a, kind) for w, h, a, d in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["image_id", "content"])

    return packed.select("image_id", "width", "height", "has_alpha", "pixels").mapInArrow(run, "image_id string, content binary")


def write_files(df: DataFrame, folder: str, name: str = "name", content: str = "content") -> None:
    """One file per row, exactly its bytes, in a folder that every executor sees; repeated tasks replace their files.
    Only the last part of a name counts; rows whose files would be one are an error."""
    base = F.substring_index(F.col(name), "/", -1)
    twice = df.groupBy(base.alias("base")).count().where("count > 1").first()
    if twice:
        raise ValueError(f"{twice['count']} rows would be the file {twice['base']}")

    def write(rows) -> None:
        os.makedirs(folder, exist_ok=True)
        for row in rows:
            target = os.path.join(folder, os.path.basename(row[name]))
            beside = f"{target}.{uuid.uuid4().hex}.part"
            with open(beside, "wb") as f:
                f.write(row[content])
            os.replace(beside, target)

    df.select(name, content).foreachPartition(write)
