"""Structure reports never fail; decoders and writers agree; streams pick up files and parts."""

import random
import struct
import zlib

import numpy as np
import pytest

from pixelsift.sinks import writers
from pixelsift.sources import images, structure


def gif(frames=2, w=5, h=4):
    out = b"GIF89a" + struct.pack("<HHBBB", w, h, 0x80, 0, 0) + bytes([255, 0, 0, 0, 0, 255])
    for k in range(frames):
        bits, n = 4, 3  # a clear code before each pixel keeps codes at 3 bits
        for v in [(i + k) % 2 for i in range(w * h)]:
            bits |= v << n | 4 << (n + 3)
            n += 6
        bits |= 5 << n
        data = bits.to_bytes((n + 10) // 8, "little")
        out += b"\x21\xf9\x04\x00\x0a\x00\x00\x00" + b"," + struct.pack("<HHHHB", 0, 0, w, h, 0) + bytes([2, len(data)]) + data + b"\0"
    return out + b"\x21\xfe\x05hello\0;"


def jpeg():
    return b"\xff\xd8\xff\xe0\x00\x10JFIF\x00\x01\x02\x00\x00\x01\x00\x01\x00\x00\xff\xfe\x00\x06note\xff\xc0\x00\x0b\x08\x00\x04\x00\x05\x01\x01\x11\x00\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00\x12\xff\x00\x34\xff\xd9"


@pytest.fixture(scope="module")
def argb():
    return np.random.default_rng(1).integers(0, 1 << 32, (12, 16), dtype=np.uint64).astype(np.uint32)


def labels(data):
    return [(kind, label, value) for _, _, kind, label, value in structure.analyse(data)]


def test_reports(argb):
    png = writers.encode_png(argb, True)
    rows = labels(png)
    assert ("field", "width", "16") in rows and ("field", "IDAT chunks", "1") in rows and not [r for r in rows if r[0] == "warn"]
    assert any("after IEND" in r[1] for r in labels(png + b"extra") if r[0] == "warn")
    assert any("CRC" in r[1] for r in labels(png[:20] + b"\xff" + png[21:]) if r[0] == "warn")
    assert any("no IEND" in r[1] for r in labels(png[:-12]) if r[0] == "warn")
    assert not [r for r in labels(writers.encode_bmp(argb)) if r[0] == "warn"]
    rows = labels(gif())
    assert ("field", "frames", "2") in rows and ("field", "comment", "hello") in rows and not [r for r in rows if r[0] == "warn"]
    rows = labels(jpeg())
    assert ("field", "comment", "note") in rows and ("field", "scan bytes", "4") in rows and not [r for r in rows if r[0] == "warn"]
    assert any("after EOI" in r[1] for r in labels(jpeg() + b"tail") if r[0] == "warn")
    assert any("multiple of 3" in r[1] for r in labels(b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 4) + b"PLTEabcd" + struct.pack(">I", zlib.crc32(b"PLTEabcd"))))


def test_fuzz(argb):
    rng = random.Random(2)
    for whole in (writers.encode_png(argb, True), writers.encode_bmp(argb), gif(), jpeg(), writers.encode_tiff(argb, True), writers.encode_jpeg(argb)):
        for n in range(0, len(whole), 3):
            structure.analyse(whole[:n])
            structure.analyse(whole[:n] + rng.randbytes(20))
        for at in range(0, len(whole), 7):
            odd = whole[:at] + bytes([whole[at] ^ 0xA5]) + whole[at + 1 :]
            structure.analyse(odd)
            try:
                images.decode(odd)
            except (ValueError, KeyError, IndexError, TypeError, struct.error, zlib.error):
                pass
    assert len(structure.analyse(b"GIF89a" + bytes([255] * 7) + rng.randbytes(400_000))) <= structure.MOST


def test_round_trips(argb):
    assert (images.decode_png(writers.encode_png(argb, True)).argb == argb).all()
    opaque = argb | np.uint32(0xFF000000)
    assert (images.decode_png(writers.encode_png(opaque, False)).argb == opaque).all()
    assert (images.decode_bmp(writers.encode_bmp(opaque)).argb == opaque).all()


@pytest.fixture
def noise():
    """A picture whose GIF fills the table of words several times over."""
    rng = np.random.default_rng(5)
    index = np.where(rng.random((300, 200)) < 0.6, rng.integers(0, 200, (300, 200)), 7)
    return (0xFF000000 | index * 0x010203 & 0xFFFFFF).astype(np.uint32)


def test_more_writers(argb, noise):
    (page,) = images.decode(writers.encode(argb, True, "tiff"))
    assert (page.argb == argb).all() and page.has_alpha
    (page,) = images.decode(writers.encode(argb, False, "tiff"))
    assert (page.argb == (argb | np.uint32(0xFF000000))).all()
    (frame,) = images.decode(writers.encode(noise, False, "gif"))
    assert (frame.argb == noise).all()
    see_through = noise & np.uint32(0x7FFFFFFF)
    see_through[0] = noise[0]
    (frame,) = images.decode(writers.encode(see_through, True, "gif"))
    assert (frame.argb[0] == noise[0]).all() and (frame.argb[1:] >> 24 == 0).all()
    y, x = np.mgrid[:120, :150].astype(np.uint32)
    many = np.uint32(0xFF000000) | (x + 90) << np.uint32(16) | (y * 2) << np.uint32(8) | (x * 7 + y * 5) % 256
    channels = lambda v: np.stack([(v >> np.uint32(s)) & 255 for s in (16, 8, 0)]).astype(int)
    assert np.abs(channels(images.decode(writers.encode(many, False, "gif"))[0].argb) - channels(many)).max() <= 26
    for quality, most in ((100, 3), (75, 40)):
        assert np.abs(channels(images.decode(writers.encode_jpeg(noise if quality == 100 else many & np.uint32(0xFFFFFF00), quality))[0].argb) - channels(noise if quality == 100 else many & np.uint32(0xFFFFFF00))).max() <= most
    with pytest.raises(ValueError):
        writers.encode(argb, True, "webp")
    assert [writers.format_of(f"x.{e}") for e in writers.WRITABLE] == ["png", "bmp", "jpeg", "gif", "tiff"]


def test_another_reader_agrees(spark, noise, tmp_path):
    """What is written here is read alike by Spark's image source."""
    rows = [(f"n.{e}", 200, 300, False, noise.astype(">u4").tobytes()) for e in ("jpg", "gif", "tif")]
    for row in rows:
        packed = spark.createDataFrame([row], "image_id string, width int, height int, has_alpha boolean, pixels binary")
        writers.write_files(writers.encoded(packed, writers.format_of(row[0])), str(tmp_path), "image_id")
    own = {r.path[-3:]: bytes(r.pixels) for r in images.read_images(structure.read_files(spark, str(tmp_path), "n.*")).collect()}
    other = {r.image_id[-3:]: bytes(r.pixels) for r in images.read_jpegs(spark, str(tmp_path)).collect()}
    assert own["gif"] == other["gif"] == own["tif"] == other["tif"] == noise.astype(">u4").tobytes()
    # transforms may round one level apart, which the colour conversion makes 1 + 1.772 of blue
    assert np.abs(np.frombuffer(own["jpg"], np.uint8).astype(int) - np.frombuffer(other["jpg"], np.uint8)).max() <= 3
    with pytest.raises(ValueError, match="2 rows"):
        writers.write_files(spark.createDataFrame([("a/n.gif", b"1"), ("b/n.gif", b"2")], "name string, content binary"), str(tmp_path))


def test_gif_frames():
    frames = images.gif_frames(gif())
    assert len(frames) == 2 and frames[0].argb[0, 0] == 0xFFFF0000 and frames[1].argb[0, 0] == 0xFF0000FF
    assert [f.argb[0, 0] for f in images.gif_frames(gif(), 1, 1)] == [0xFF0000FF] and len(images.gif_frames(gif(), 0, 1)) == 1
    for data in (gif(), writers.encode_png(frames[0].argb, False)):
        with pytest.raises(ValueError, match="no frame 2"):
            images.decode(data, 2)
    with pytest.raises(ValueError):
        images.decode(b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0, 0, 0) + b",")


def png(w, h, depth, colour, lines, extra=b"", interlace=0):
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, interlace)) + extra + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_png_kinds():
    grey = images.decode_png(png(2, 1, 8, 0, b"\0\x64\x0a")).argb
    assert [hex(v) for v in grey[0]] == ["0xffa8a8a8", "0xff383838"]
    one = images.decode_png(png(8, 1, 1, 0, b"\0\xa0")).argb
    assert [v & 255 for v in one[0].tolist()] == [255, 0, 255, 0, 0, 0, 0, 0]
    plte = struct.pack(">I", 6) + b"PLTE" + bytes([1, 2, 3, 4, 5, 6]) + bytes(4)
    pal = images.decode_png(png(2, 1, 8, 3, b"\0\x01\x00", plte))
    assert pal.argb.tolist() == [[0xFF040506, 0xFF010203]] and pal.indices.tolist() == [[1, 0]]
    deep = images.decode_png(png(1, 1, 16, 2, b"\0\x01\xc8\xff\xff\x00\x00")).argb
    assert deep[0, 0] == 0xFF02FF00
    rows = [[1, 2, 3, 4], [9, 9, 9, 9], [5, 1, 7, 2]]
    for kind in range(5):  # each filter, made here and undone there
        raw, above = b"", [0] * 4
        for row in rows:
            left = [0, *row[:-1]]
            corner = [0, *above[:-1]]
            paeth = [min((a, b, c), key=lambda v, a=a, b=b, c=c: abs(a + b - c - v)) for a, b, c in zip(left, above, corner)]
            guess = [[0] * 4, left, above, [(a + b) // 2 for a, b in zip(left, above)], paeth][kind]
            raw += bytes([kind, *[(v - g) & 255 for v, g in zip(row, guess)]])
            above = row
        lut = images.gray_to_srgb()
        assert (images.decode_png(png(4, 3, 8, 0, raw)).argb & 255).tolist() == [[int(lut[v]) for v in row] for row in rows]
    full = np.arange(64).reshape(8, 8)
    raw = b"".join(b"\0" + bytes(full[y, x0::dx].tolist()) for x0, y0, dx, dy in images._ADAM7 for y in range(y0, 8, dy))
    assert (images.decode_png(png(8, 8, 8, 0, raw, interlace=1)).argb & 255).tolist() == images.gray_to_srgb()[full].tolist()


def test_spark_readers_and_writers(spark, argb, tmp_path):
    packed = spark.createDataFrame([("a.png", 16, 12, True, argb.astype(">u4").tobytes())], "image_id string, width int, height int, has_alpha boolean, pixels binary")
    writers.write_files(writers.encoded(packed), str(tmp_path), "image_id")
    (tmp_path / "bad.png").write_bytes(b"\x89PNG\r\n\x1a\nnothing")
    files = structure.read_files(spark, str(tmp_path), "*.png")
    got = {r.path.rsplit("/", 1)[1]: r for r in images.read_images(files).collect()}
    assert bytes(got["a.png"].pixels) == argb.astype(">u4").tobytes() and got["bad.png"].error
    px = images.to_long(packed)
    assert px.count() == 192 and bytes(images.to_packed(px).first().pixels) == argb.astype(">u4").tobytes()
    lines = structure.as_text(structure.report(files)).collect()
    assert any(r.line.startswith("format: PNG") for r in lines)


def test_streams(spark, argb, tmp_path):
    from pixelsift.streaming import arriving

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.bmp").write_bytes(writers.encode_bmp(argb))
    seen = []
    query = arriving.each_batch(arriving.arriving_reports(spark, str(folder)), lambda df, _: seen.extend(df.collect()), str(tmp_path / "check"))
    query.awaitTermination()
    assert any(r.label == "format" and r.value == "BMP" for r in seen)

    source = tmp_path / "parts"
    rows = [(7, 2, 1, b"b"), (7, 2, 0, b"a"), (8, 2, 0, b"x"), (9, 1, 0, b"p"), (9, 1, 0, b"q")]
    spark.createDataFrame(rows, "append_parity int, append_total int, append_index int, payload binary").write.parquet(str(source))
    stream = spark.readStream.schema("append_parity int, append_total int, append_index int, payload binary").parquet(str(source))
    found = []
    query = arriving.each_batch(arriving.collected_parts(stream), lambda df, _: found.extend(df.collect()), str(tmp_path / "check2"))
    query.awaitTermination()
    assert [(r.append_parity, bytes(r.payload)) for r in found] == [(7, b"ab")]
