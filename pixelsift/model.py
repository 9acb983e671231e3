"""Schemas, the transform catalogue and other small tables of fixed values.

Images come in two layouts. *Long*: one row per pixel, (image_id, x, y, argb) with argb a BIGINT in
0..2^32-1; everything relational works on it. *Packed*: one row per image with its pixels as big-endian
ARGB bytes; searches that try many configurations work on it, inside one Arrow batch.
"""

from __future__ import annotations

PIXELS = "image_id string, x int, y int, argb long"
PACKED = "image_id string, width int, height int, has_alpha boolean, pixels binary"
HITS = (
    "image_id string, hit_no int, format string, text string, payload binary, located boolean, "
    "bx double, by double, append_index int, append_total int, append_parity int"
)
REPORT = "path string, seq int, section_no int, section string, kind string, label string, value string"

#: Largest file read, and most pixels decoded.
MAX_FILE_BYTES, MAX_PIXELS = 512 << 20, 64_000_000

# Shift of each channel in 0xAARRGGBB, in the order in which channels are numbered.
CHANNELS = {"alpha": 24, "red": 16, "green": 8, "blue": 0}

# Channel orders by code.
RGB_ORDERS = {1: "RGB", 2: "RBG", 3: "GRB", 4: "GBR", 5: "BRG", 6: "BGR"}

# Constants of the three random colour maps, in the order bm, ba, bx, gm, ga, gx, rm, ra, rx.
RANDOM_MAPS = {
    1: (27, 65, 235, 183, 71, 60, 184, 192, 162),
    2: (27, 115, 105, 80, 145, 14, 95, 32, 133),
    3: (27, 183, 149, 29, 35, 200, 39, 171, 228),
}
# Fixed value: the seed of the first random colour map; the others follow it.
RANDOM_SEED = 0x5EED0001

# Payload types with category, file extension and description.
PAYLOAD_TYPES = {
    "EMPTY": ("EMPTY", "", "no bytes"),
    "ZIP": ("ARCHIVE", "zip", "ZIP archive"),
    "SEVEN_ZIP": ("ARCHIVE", "7z", "7-Zip archive"),
    "RAR": ("ARCHIVE", "rar", "RAR archive"),
    "GZIP": ("ARCHIVE", "gz", "gzip stream"),
    "BZIP2": ("ARCHIVE", "bz2", "bzip2 stream"),
    "XZ": ("ARCHIVE", "xz", "xz stream"),
    "TAR": ("ARCHIVE", "tar", "tar archive"),
    "PNG": ("IMAGE", "png", "PNG image"),
    "JPEG": ("IMAGE", "jpg", "JPEG image"),
    "GIF": ("IMAGE", "gif", "GIF image"),
    "BMP": ("IMAGE", "bmp", "BMP image"),
    "WEBP": ("IMAGE", "webp", "WebP image"),
    "PDF": ("DOCUMENT", "pdf", "PDF document"),
    "ELF": ("EXECUTABLE", "elf", "ELF binary"),
    "PE": ("EXECUTABLE", "exe", "PE binary"),
    "JAVA_CLASS": ("EXECUTABLE", "class", "Java class"),
    "TEXT_UTF8": ("TEXT", "txt", "UTF-8 text"),
    "TEXT_ASCII": ("TEXT", "txt", "ASCII text"),
    "BASE64_TEXT": ("TEXT", "txt", "base64 text"),
    "BINARY": ("BINARY", "bin", "unknown bytes"),
}

# Leading bytes (hex) of payload types, tested in this order.
SIGNATURES = (
    ("504B0304", "ZIP"), ("504B0506", "ZIP"), ("504B0708", "ZIP"),
    ("377ABCAF271C", "SEVEN_ZIP"), ("526172211A07", "RAR"), ("1F8B", "GZIP"), ("425A68", "BZIP2"), ("FD377A585A00", "XZ"),
)
# Those tested after the tar magic at byte 257.
LATER_SIGNATURES = (
    ("89504E470D0A1A0A", "PNG"), ("FFD8FF", "JPEG"), ("474946383761", "GIF"), ("474946383961", "GIF"), ("424D", "BMP"),
)
# Those tested after WebP.
LAST_SIGNATURES = (("25504446", "PDF"), ("7F454C46", "ELF"), ("4D5A", "PE"), ("CAFEBABE", "JAVA_CLASS"))

# Fixed value: names that a flag may start with.
FLAG_NAMES = "flag|ctf|steg|key|secret|pico|htb|thm"


def transforms() -> list[tuple[int, str, str | None, int | None, str]]:
    """The numbered transforms: (index, kind, channel, plane, label)."""
    out: list = [(0, "original", None, None, "Normal Image"), (1, "invert", None, None, "Colour Inversion (Xor)")]
    for channel in CHANNELS:
        out += [(len(out) + k, "plane", channel, 7 - k, f"{channel.capitalize()} plane {7 - k}") for k in range(8)]
    out += [(34 + k, "full", channel, None, f"Full {channel}") for k, channel in enumerate(CHANNELS)]
    out += [(37 + k, "map", None, k, f"Random colour map {k}") for k in (1, 2, 3)]
    return [*out, (41, "gray", None, None, "Gray bits")]
