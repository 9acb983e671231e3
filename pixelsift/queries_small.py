"""Queries of the small operators: dimension tables, texts, regions, search, reports and sequences, each with its SQL."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelsift.functions import pixels as P
from pixelsift.functions import regions, registry
from pixelsift.model import PAYLOAD_TYPES, RANDOM_SEED
from pixelsift.operators import catalogue, grids, lsbscan, payload, symbols
from pixelsift.operators import extract as X
from pixelsift.plans import carriers as C
from pixelsift.sinks import writers
from pixelsift.sources import images, structure

_Q: dict = {}
_SQL: dict[str, str] = {}


def _add(name: str, query, sql: str) -> None:
    _Q[name], _SQL[name] = query, sql


def _text(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


# -- catalogue ----------------------------------------------------------------------------------------------

_CHANNELS = "(VALUES (0, 'alpha', 24), (1, 'red', 16), (2, 'green', 8), (3, 'blue', 0)) c(n, channel, shift)"
_CATALOGUE = (
    "SELECT 0 AS idx, 'original' AS kind, NULL AS channel, NULL AS number, 'Normal Image' AS label UNION ALL SELECT 1, 'invert', NULL, NULL, 'Colour Inversion (Xor)' "
    f"UNION ALL SELECT 2 + 8 * n + CAST(k AS INTEGER), 'plane', channel, 7 - CAST(k AS INTEGER), upper(channel[1]) || channel[2:] || ' plane ' || (7 - k) FROM {_CHANNELS}, range(8) r(k) "
    f"UNION ALL SELECT 34 + n, 'full', channel, NULL, 'Full ' || channel FROM {_CHANNELS} UNION ALL SELECT 37 + CAST(k AS INTEGER), 'map', NULL, CAST(k AS INTEGER), 'Random colour map ' || k FROM range(1, 4) r(k) "
    "UNION ALL SELECT 41, 'gray', NULL, NULL, 'Gray bits'"
)
_GROUPED = f"SELECT *, CASE kind WHEN 'plane' THEN channel || ' planes' WHEN 'map' THEN 'random maps' ELSE kind END AS \"group\" FROM ({_CATALOGUE})"


def _neighbour(name: str, way: str, edge: str, part: str) -> str:
    over = f"OVER ({part} ORDER BY idx)"
    return f"coalesce({way}(idx) {over}, {edge}(idx) OVER ({part})) AS {name}"


_add("transform_catalogue", lambda s, d: catalogue.catalogue(s).select("idx", "kind", "channel", "number", "label"), f"SELECT CAST(idx AS INTEGER) AS idx, kind, channel, CAST(number AS INTEGER) AS number, label FROM ({_CATALOGUE})")
_add(
    "transform_neighbours", lambda s, d: catalogue.catalogue(s).drop("kind", "channel", "number", "label"),
    "SELECT idx, \"group\", " + ", ".join(_neighbour(f"{n}{suffix}", way, edge, part) for suffix, part in (("", ""), ("_in_group", 'PARTITION BY "group"')) for n, way, edge in (("next", "lead", "min"), ("previous", "lag", "max")))
    + f" FROM (SELECT CAST(idx AS INTEGER) AS idx, \"group\" FROM ({_GROUPED}))",
)
_add("transform_groups", lambda s, d: catalogue.groups(s).select("group", "first_idx", F.concat_ws(",", F.col("idxs").cast("array<string>")).alias("idxs")), f"SELECT \"group\", CAST(min(idx) AS INTEGER) AS first_idx, string_agg(idx, ',' ORDER BY idx) AS idxs FROM ({_GROUPED}) GROUP BY 1")


def _palette_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = C.table(spark, sf_dir, "customer").select(F.lit("c").alias("image_id"), (F.col("c_custkey") % 40).cast("int").alias("x"), F.floor(F.col("c_custkey") / 40).cast("int").alias("y"), (F.col("c_nationkey") - 1 + 3 * (F.col("c_custkey") % 2)).cast("int").alias("pal_idx"))
    return grids.palette_map(px, catalogue.random_palette(spark, RANDOM_SEED, 24).withColumn("image_id", F.lit("c"))).select("x", "y", "argb")


# each draw is a step of the generator; the palette's entry i takes draws 3 i + 1 to 3 i + 3
_DRAWS = f"WITH RECURSIVE g(i, s) AS (SELECT 0, CAST(xor({RANDOM_SEED}, 25214903917) AS HUGEINT) UNION ALL SELECT i + 1, (s * 25214903917 + 11) % 281474976710656 FROM g WHERE i < 72), v AS (SELECT (i - 1) // 3 AS p, (i - 1) % 3 AS k, CAST(s // 1099511627776 AS BIGINT) AS b FROM g WHERE i > 0), pal AS (SELECT p, 4278190080 + sum(b * CASE k WHEN 0 THEN 65536 WHEN 1 THEN 256 ELSE 1 END) AS argb FROM v GROUP BY p) "
_add("palette_random", lambda s, d: catalogue.random_palette(s, RANDOM_SEED, 24), _DRAWS + "SELECT CAST(p AS INTEGER) AS pal_idx, CAST(argb AS BIGINT) AS argb FROM pal")
_add(
    "transform_random_palette", _palette_through,
    _DRAWS + "SELECT CAST(c_custkey % 40 AS INTEGER) AS x, CAST(c_custkey // 40 AS INTEGER) AS y, CAST(argb AS BIGINT) AS argb FROM customer JOIN pal ON p = greatest(0, least(23, c_nationkey - 1 + 3 * (c_custkey % 2)))",
)
_add(
    "palette_adjacent_equal", lambda s, d: symbols.adjacent_equal(C.table(s, d, "nation").select(F.lit("n").alias("image_id"), F.col("n_nationkey").alias("pal_idx"), F.floor(F.col("n_nationkey") / 3).alias("argb"))).select("pal_idx", "argb"),
    "SELECT n_nationkey AS pal_idx, CAST(n_nationkey // 3 AS BIGINT) AS argb FROM nation QUALIFY n_nationkey // 3 = lag(n_nationkey // 3) OVER (ORDER BY n_nationkey)",
)

# -- texts, regions and steps -------------------------------------------------------------------------------


def _nation(columns):
    """Columns of (nation key, region key) on the nations; made when a session is there."""
    return lambda s, d: C.table(s, d, "nation").select("n_nationkey", *columns(F.col("n_nationkey"), F.col("n_regionkey")))


def _parts_of(r, prefix: str = "") -> list:
    return [r[f].alias(prefix + f) for f in ("x", "y", "width", "height")]


def _rect_sql(x0: str, y0: str, x1: str, y1: str, prefix: str = "") -> str:
    edges = f"CAST({x0} AS INTEGER) AS {prefix}x, CAST({y0} AS INTEGER) AS {prefix}y"
    return f"{edges}, CAST(greatest(0, {x1} - {x0}) AS INTEGER) AS {prefix}width, CAST(greatest(0, {y1} - {y0}) AS INTEGER) AS {prefix}height"


_add("region_corners", _nation(lambda k, r: [*_parts_of(regions.from_corners(k, F.lit(9), F.lit(12), r))]), f"SELECT n_nationkey, {_rect_sql('least(n_nationkey, 12)', 'least(9, n_regionkey)', '(greatest(n_nationkey, 12) + 1)', '(greatest(9, n_regionkey) + 1)')} FROM nation")
_add("region_clamp", _nation(lambda k, r: [*_parts_of(regions.clamp(regions.region(k - 5, r - 2, 9, 4), F.lit(15), F.lit(5)))]), f"SELECT n_nationkey, {_rect_sql('greatest(n_nationkey - 5, 0)', 'greatest(n_regionkey - 2, 0)', 'least(n_nationkey + 4, 15)', 'least(n_regionkey + 2, 5)')} FROM nation")
_add("region_expand", _nation(lambda k, r: [*_parts_of(regions.expand(regions.region(k, r, 3, 2), 2, F.lit(20), F.lit(5)))]), f"SELECT n_nationkey, {_rect_sql('greatest(n_nationkey - 2, 0)', 'greatest(n_regionkey - 2, 0)', 'least(n_nationkey + 5, 20)', 'least(n_regionkey + 4, 5)')} FROM nation")
_add("region_scaled", _nation(lambda k, r: [*_parts_of(regions.scaled(regions.region(k, r, 3, 5), 1.5))]), f"SELECT n_nationkey, {_rect_sql('floor(n_nationkey * 1.5)', 'floor(n_regionkey * 1.5)', 'ceil((n_nationkey + 3) * 1.5)', 'ceil((n_regionkey + 5) * 1.5)')} FROM nation")
_add("region_contains", _nation(lambda k, r: [regions.contains(regions.region(3, 1, k, 3), F.lit(9), r).alias("inside"), regions.is_empty(regions.region(0, 0, k - 3, 1)).alias("is_empty")]), "SELECT n_nationkey, 9 >= 3 AND 9 < 3 + n_nationkey AND n_regionkey >= 1 AND n_regionkey < 4 AS inside, n_nationkey - 3 <= 0 AS is_empty FROM nation")
_add("selection_text", _nation(lambda k, r: [regions.selection_text(regions.region(k, r, 7, 8)).alias("text")]), "SELECT n_nationkey, '7 × 8 at ' || n_nationkey || ', ' || n_regionkey AS text FROM nation")
_add(
    "device_rectangle", _nation(lambda k, r: [*_parts_of(regions.device_rectangle(k / 3.0, r / 2.0, k + 0.2, F.lit(0.1), (r - 1) * 0.75, F.lit(2.0)))]),
    "WITH s AS (SELECT *, CASE WHEN n_regionkey - 1 <= 0 THEN 1.0 ELSE (n_regionkey - 1) * 0.75 END AS k FROM nation) SELECT n_nationkey, CAST(floor(n_nationkey / 3.0 * k) AS INTEGER) AS x, CAST(n_regionkey AS INTEGER) AS y, CAST(greatest(1, ceil((n_nationkey + 0.2) * k)) AS INTEGER) AS width, 1 AS height FROM s",
)
_add("stereo_step", _nation(lambda k, r: [regions.step_offset(k - 7, F.lit(11)).alias("next"), regions.step_offset(k - 7, F.lit(11), -1).alias("previous")]), "SELECT n_nationkey, CAST((n_nationkey - 7 + 22 + 1) % 11 AS INTEGER) AS next, CAST((n_nationkey - 7 + 22 - 1) % 11 AS INTEGER) AS previous FROM nation")


def _mapped_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = C.table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") % 20).alias("x"), F.col("n_regionkey").alias("y"))
    out = [c for t in (1, 2, 3) for c, n in zip(regions.turn_back(F.col("x"), F.col("y"), t, F.lit(30), F.lit(20)), ("x", "y"))]
    names = [f"{n}{t}" for t in (1, 2, 3) for n in ("x", "y")]
    return px.select("n_nationkey", *[c.cast("int").alias(n) for c, n in zip(out, names)], regions.scale_back(F.col("x"), 2.5).alias("scaled"), regions.zoom_to_image(F.col("x"), F.lit(3), F.lit(1.5)).alias("zoomed"))


_add(
    "map_back", _mapped_back,
    "SELECT n_nationkey, CAST(29 - y AS INTEGER) AS x1, CAST(x AS INTEGER) AS y1, CAST(29 - x AS INTEGER) AS x2, CAST(19 - y AS INTEGER) AS y2, CAST(y AS INTEGER) AS x3, CAST(19 - x AS INTEGER) AS y3, x / 2.5::DOUBLE AS scaled, (x - 3) / 1.5::DOUBLE AS zoomed FROM (SELECT n_nationkey, n_nationkey % 20 AS x, n_regionkey AS y FROM nation)",
)
_add("byte_sizes", _nation(lambda k, r: [regions.byte_size((k * k * k * 501).cast("long")).alias("size"), regions.percent(r / 8.0).alias("share")]), "SELECT n_nationkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN format('{:.1f} KiB', n / 1024.0::DOUBLE) ELSE format('{:.1f} MiB', n / 1048576.0::DOUBLE) END AS size, format('{:.1f} %', n_regionkey * 12.5::DOUBLE) AS share FROM (SELECT n_nationkey, n_regionkey, CAST(n_nationkey AS BIGINT) * n_nationkey * n_nationkey * 501 AS n FROM nation)")
_FLAT = r"trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))"
_add("snippets", lambda s, d: C.table(s, d, "documents").select("doc_id", regions.snippet(F.col("text")).alias("snippet")), f"SELECT doc_id, CASE WHEN length(t) > 32 THEN t[1:31] || '…' ELSE t END AS snippet FROM (SELECT doc_id, {_FLAT} AS t FROM documents)")
_add("pixel_channels", lambda s, d: C.events_px(s, d).select("x", "y", P.channel_text(F.col("argb")).alias("channels")), f"SELECT x, y, 'A ' || (argb >> 24) || ', R ' || ((argb >> 16) & 255) || ', G ' || ((argb >> 8) & 255) || ', B ' || (argb & 255) AS channels FROM {C.EVENTS_SQL}")
_add(
    "bounding_box",
    lambda s, d: symbols.bounding_box(C.table(s, d, "events").select("event_id", F.when(F.col("event_id") % 9 == 0, F.array().cast("array<struct<x:double,y:double>>")).otherwise(F.array(*[F.struct((F.col("event_id") % m / 2.0).alias("x"), (F.col("user_id") % n / 4.0).alias("y")) for m, n in ((61, 47), (53, 31), (17, 90))])).alias("points"), F.lit(27).alias("width"), F.lit(20).alias("height"))).select("event_id", "x0", "y0", "x1", "y1"),
    "SELECT event_id, " + ", ".join(
        f"CAST(CASE WHEN event_id % 9 = 0 THEN {edge} WHEN {low} THEN greatest(0, floor(least({', '.join(v)})) - 3) ELSE least({edge}, ceil(greatest({', '.join(v)})) + 3) END AS INTEGER) AS {n}"
        for n, low, edge, v in (
            ("x0", "true", 0, [f"event_id % {m} / 2.0" for m in (61, 53, 17)]), ("y0", "true", 0, [f"user_id % {m} / 4.0" for m in (47, 31, 90)]),
            ("x1", "false", 27, [f"event_id % {m} / 2.0" for m in (61, 53, 17)]), ("y1", "false", 20, [f"user_id % {m} / 4.0" for m in (47, 31, 90)]),
        )
    ) + " FROM events",
)

# -- payload types ------------------------------------------------------------------------------------------


def _types(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("name")
    return spark.createDataFrame([(k,) for k in PAYLOAD_TYPES], "name string").select("name", payload.type_field(name, 0).alias("category"), payload.type_field(name, 1).alias("extension"), payload.is_unsafe(name).alias("unsafe"), payload.badge(name).alias("badge"))


_add(
    "payload_types", _types,
    "SELECT name, category, extension, category IN ('ARCHIVE', 'EXECUTABLE', 'DOCUMENT') AS unsafe, replace(name, '_', ' ') AS badge FROM (VALUES "
    "('EMPTY', 'EMPTY', ''), ('ZIP', 'ARCHIVE', 'zip'), ('SEVEN_ZIP', 'ARCHIVE', '7z'), ('RAR', 'ARCHIVE', 'rar'), ('GZIP', 'ARCHIVE', 'gz'), ('BZIP2', 'ARCHIVE', 'bz2'), ('XZ', 'ARCHIVE', 'xz'), ('TAR', 'ARCHIVE', 'tar'), ('PNG', 'IMAGE', 'png'), ('JPEG', 'IMAGE', 'jpg'), ('GIF', 'IMAGE', 'gif'), ('BMP', 'IMAGE', 'bmp'), ('WEBP', 'IMAGE', 'webp'), "
    "('PDF', 'DOCUMENT', 'pdf'), ('ELF', 'EXECUTABLE', 'elf'), ('PE', 'EXECUTABLE', 'exe'), ('JAVA_CLASS', 'EXECUTABLE', 'class'), ('TEXT_UTF8', 'TEXT', 'txt'), ('TEXT_ASCII', 'TEXT', 'txt'), ('BASE64_TEXT', 'TEXT', 'txt'), ('BINARY', 'BINARY', 'bin')) t(name, category, extension)",
)


def _entropy_by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry.register(spark)
    return C.payloads(spark, sf_dir).select("payload_id", F.round(F.expr("sift_entropy(data)"), 6).alias("entropy"))


_add(
    "udf_entropy", _entropy_by_sql,
    f"WITH p AS {C.PAYLOADS_SQL}, b AS (SELECT payload_id, unnest(regexp_extract_all(hex(data), '..')) AS v FROM p), h AS (SELECT payload_id, v, count(*) AS k FROM b GROUP BY ALL), n AS (SELECT payload_id, sum(k) AS n FROM h GROUP BY 1) "
    "SELECT p.payload_id, round(coalesce(e, 0.0) + 0.0, 6) AS entropy FROM p LEFT JOIN (SELECT payload_id, -sum((k / n) * log2(k / n)) AS e FROM h JOIN n USING (payload_id) GROUP BY 1) USING (payload_id)",
)


def _dump_by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry.register(spark)
    C.table(spark, sf_dir, "supplier").createOrReplaceTempView("sift_suppliers")
    return spark.sql("SELECT s_suppkey, l.line_no, l.offset, l.hex, l.shown FROM sift_suppliers, LATERAL sift_hex_dump(cast(s_name AS binary)) l")


_add("udtf_hex_dump", _dump_by_sql, "SELECT s_suppkey, CAST(i AS INTEGER) AS line_no, printf('%08x', i * 16) AS \"offset\", lower(hex(encode(s_name[i * 16 + 1:i * 16 + 16]))) AS hex, s_name[i * 16 + 1:i * 16 + 16] AS shown FROM (SELECT s_suppkey, s_name, unnest(range(CAST(ceil(length(s_name) / 16.0) AS BIGINT))) AS i FROM supplier)")

# -- search -------------------------------------------------------------------------------------------------

_SIX = ["RGB", "RBG", "GRB", "GBR", "BRG", "BGR"]


def _blocks(deep: bool) -> str:
    """SQL for the list of configurations: (block, place in it, channels, planes, order, by rows, LSB first, inverted)."""
    out: list[str] = []

    def block(channels: str, planes: str, orders: list[str], lsb: tuple, flips: tuple) -> None:
        values = lambda xs: "(VALUES " + ", ".join(f"({i}, {_text(x) if isinstance(x, str) else str(x).lower()})" for i, x in enumerate(xs)) + ")"
        cols = [values(x) + " " for x in (orders, (True, False), lsb, flips)]
        names = ("o(i, v)", "r(i, v)", "l(i, v)", "f(i, v)")
        sql = f"SELECT {len(out)} AS block, o.i * 8 + r.i * 4 + l.i * 2 + f.i AS place, '{channels}' AS channels, '{planes}' AS planes, o.v AS rgb_order, r.v AS row_first, l.v AS lsb_first, f.v AS invert_bits FROM " + ", ".join(c + n for c, n in zip(cols, names))
        out.append(sql)

    def single(channel: str, variants: list[tuple]) -> None:
        rows = ", ".join(f"({i}, '{planes}', {str(lsb).lower()}, {str(flip).lower()})" for i, (planes, lsb, flip) in enumerate(variants))
        out.append(f"SELECT {len(out)}, r.i * 8 + v.i, '{channel}', v.planes, 'RGB', r.v, v.lsb, v.flip FROM (VALUES (0, true), (1, false)) r(i, v), (VALUES {rows}) v(i, planes, lsb, flip)")

    two, both = ["RGB", "BGR"], (False, True)
    block("RGB", "0", _SIX, (True,), both)
    block("RGB", "1", two, (True,), (False,))
    block("RGB", "2", two, (True,), (False,))
    block("RGB", "01", _SIX, (True, False), both)
    block("RGB", "012", two, (True, False), (False,))
    for c in "RGB":
        single(c, [("0", True, False), ("0", True, True), ("1", True, False), ("01", True, False), ("01", False, False)])
    single("A", [("0", True, False), ("0", True, True)])
    block("ARGB", "0", two, (True,), both)
    if deep:
        block("RGB", "012", _SIX[1:5], (True, False), (False,))
        block("RGB", "0123", two, (True, False), (False,))
        block("RGB", "7", two, (False,), (False,))
        for c in "RGB":
            single(c, [("2", True, False), ("7", False, False)])
    mask = "CAST(list_sum(list_transform(regexp_extract_all(planes, '.'), lambda p: list_sum(list_transform(regexp_extract_all(channels, '.'), lambda c: CAST(1 AS BIGINT) << CAST((position(c IN 'ARGB') - 1) * 8 + CAST(p AS INTEGER) AS INTEGER))))) AS BIGINT)"
    name = "CASE channels WHEN 'RGB' THEN rgb_order WHEN 'ARGB' THEN 'A+' || rgb_order ELSE channels END"
    label = f"{name} || ' · b' || array_to_string(regexp_extract_all(planes, '.'), ',') || CASE WHEN row_first THEN ' · Row' ELSE ' · Col' END || CASE WHEN lsb_first THEN ' · LSB' ELSE ' · MSB' END || CASE WHEN invert_bits THEN ' · Inverted' ELSE '' END"
    return f"SELECT CAST(row_number() OVER (ORDER BY block, place) - 1 AS INTEGER) AS opt_idx, {mask} AS plane_mask, rgb_order, lsb_first, row_first, invert_bits, {label} AS label FROM ({' UNION ALL '.join(out)})"


for _name, _make in (("fast", X.fast_configs), ("deep", X.deep_configs)):
    _add(f"lsb_configs_{_name}", lambda s, d, m=_make: lsbscan.config_table(s, m(True)), _blocks(_name == "deep"))


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = C.table(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("n"))
    return lsbscan.config_table(spark, X.deep_configs(True)).crossJoin(F.broadcast(n)).select("opt_idx", F.expr("(bit_count(plane_mask) * n + 7) div 8").cast("long").alias("size"))  # one row


_add("extract_sizes", _sizes, f"SELECT opt_idx, CAST((bit_count(plane_mask) * n + 7) // 8 AS BIGINT) AS size FROM ({_blocks(True)}), (SELECT count(*) AS n FROM events)")
_STEGO = b"flag{bits-in-plain-sight}" + b" padded with readable words" * 2
_STEGO_SQL = (
    "(SELECT 'events' AS image_id, CAST(i % 100 AS INTEGER) AS x, CAST(i // 100 AS INTEGER) AS y, CAST(" + " + ".join(
        f"CASE WHEN i * 3 + {k} < {8 * len(_STEGO)} THEN (m[CAST(i * 3 + {k} + 1 AS BIGINT)]::BIGINT - ((a >> {shift}) & 1)) * {1 << shift} ELSE 0 END" for k, shift in enumerate((16, 8, 0))
    ) + f" + a AS BIGINT) AS argb FROM (SELECT event_id AS i, (event_id * 2654435761 + user_id * 40503 + 97) % 4294967296 AS a, '{''.join(f'{b:08b}' for b in _STEGO)}' AS m FROM events))"
)


def _extract_hex(cfg: X.Config) -> str:
    """SQL for the whole extract of one configuration as hex digits."""
    bits = cfg.bits()
    rank = "y * w + x" if cfg.row_first else "x * h + y"
    value = "1 - ((argb >> b) & 1)" if cfg.invert else "(argb >> b) & 1"
    planes = ", ".join(f"({i}, {b})" for i, b in enumerate(bits))
    return (
        f"WITH p AS (SELECT * FROM {_STEGO_SQL}), s AS (SELECT max(x) + 1 AS w, max(y) + 1 AS h FROM p), b AS (SELECT CAST({rank} AS BIGINT) * {len(bits)} + i AS pos, {value} AS bit FROM p, s, (VALUES {planes}) v(i, b)), "
        "y AS (SELECT pos // 8 AS k, sum(bit << CAST(7 - pos % 8 AS INTEGER)) AS v FROM b GROUP BY 1) SELECT string_agg(printf('%02X', CAST(v AS INTEGER)), '' ORDER BY k) AS h FROM y"
    )


_add(
    "extract_full", lambda s, d: lsbscan.extract_full(images.to_packed(C.stego_px(s, d)), X.fast_configs(True)[0]).select("image_id", F.sha2("data", 256).alias("sha256"), "total_bytes"),
    f"SELECT 'events' AS image_id, sha256(from_hex(h)) AS sha256, CAST(length(h) // 2 AS BIGINT) AS total_bytes FROM ({_extract_hex(X.fast_configs(True)[0])})",
)
#: A few configurations, two of them with one content, whose search SQL can follow from pixels to ranks.
_FEW = [X.config("R", [0], lsb_first=True), X.config("RGB", [0], lsb_first=True), X.config("RGB", [0]), X.config("G", [7], row_first=False), X.config("ARGB", [0], order="BGR", invert=True)]
_PRINTABLE = "len(list_filter(regexp_extract_all(h, '..'), lambda v: v BETWEEN '20' AND '7E'))"
_SEEN = "array_to_string(list_transform(regexp_extract_all(h[1:32768], '..'), lambda v: CASE WHEN v BETWEEN '20' AND '7E' THEN decode(from_hex(v)) ELSE chr(1) END), '')"
_add(
    "lsb_scan_few", lambda s, d: lsbscan.scan(images.to_packed(C.stego_px(s, d)), configs=_FEW, max_bytes=None).select("rank", "opt_idx", "score", "sha256", "total_bytes"),
    "WITH c AS (" + " UNION ALL ".join(f"SELECT {i} AS opt_idx, h FROM ({_extract_hex(c)})" for i, c in enumerate(_FEW)) + "), "
    "v AS (SELECT opt_idx, unnest(regexp_extract_all(h, '..')) AS v, length(h) / 2 AS n FROM c), k AS (SELECT opt_idx, v, n, count(*) AS k FROM v GROUP BY ALL), e AS (SELECT opt_idx, -sum(k / n * log2(k / n)) AS ent, count(*) AS dist FROM k GROUP BY 1), "
    f"q AS (SELECT opt_idx, h, {_PRINTABLE} / (length(h) / 2) AS printable, regexp_matches({_SEEN}, '(?i)(flag|ctf|steg|key|secret|pico|htb|thm)[{{][\\x20-\\x7E]{{1,128}}?[}}]') AS flagged FROM c), "
    # noise in these carriers has no signature, so flags, shares and entropy decide
    "z AS (SELECT opt_idx, sha256(from_hex(h)) AS sha256, CAST(length(h) // 2 AS BIGINT) AS total_bytes, CAST(CASE WHEN flagged THEN 98 WHEN printable > 0.7 THEN 65 WHEN dist < 5 THEN 5 WHEN ent > 7.6 THEN 15 WHEN dist >= 16 AND ent BETWEEN 3 AND 7 THEN 30 ELSE 20 END AS INTEGER) AS score FROM q JOIN e USING (opt_idx)), "
    "o AS (SELECT sha256, total_bytes, max(score) AS score, min(opt_idx) AS first, arg_min(opt_idx, (-score, opt_idx)) AS opt_idx FROM z GROUP BY 1, 2) SELECT CAST(row_number() OVER (ORDER BY score DESC, first) AS INTEGER) AS rank, CAST(opt_idx AS INTEGER) AS opt_idx, score, sha256, total_bytes FROM o",
)

# -- reports ------------------------------------------------------------------------------------------------


def _bmp(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = writers.encoded(images.to_packed(C.events_px(spark, sf_dir)), "bmp").select(F.col("image_id").alias("path"), "content")
    return structure.report(files).where("kind = 'field' AND label != 'sha256'").select("section", "label", "value")


_add(
    "structure_bmp_fields", _bmp,
    "WITH s AS (SELECT max(x) + 1 AS w, max(y) + 1 AS h FROM " + C.EVENTS_SQL + "), t AS (SELECT w, h, (w * 24 + 31) // 32 * 4 AS stride FROM s), n AS (SELECT *, 54 + stride * h AS size FROM t) "
    "SELECT unnest(['File', 'File', 'BMP file header', 'BMP file header', 'BMP info header', 'BMP info header', 'BMP info header', 'BMP info header', 'BMP info header', 'BMP info header', 'BMP info header', 'BMP pixels']) AS section, "
    "unnest(['size', 'format', 'declared size', 'pixel offset', 'header size', 'width', 'height', 'planes', 'bits per pixel', 'compression', 'colours used', 'stride']) AS label, "
    "unnest([size::VARCHAR, 'BMP', size::VARCHAR, '54', '40', w::VARCHAR, h::VARCHAR, '1', '24', 'none', '0', stride::VARCHAR]) AS value FROM n",
)


def _png_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = writers.encoded(images.to_packed(C.events_px(spark, sf_dir)), "png").select(F.col("image_id").alias("path"), "content")
    return structure.report(files).where("kind IN ('field', 'warn') AND (section LIKE 'IHDR%' OR label = 'format' OR kind = 'warn')").select("kind", "label", "value")


_add(
    "structure_png_header", _png_header,
    "SELECT 'field' AS kind, unnest(['format', 'length', 'meaning', 'width', 'height', 'bit depth', 'colour type', 'interlace', 'pixels', 'raw bytes']) AS label, unnest(['PNG', '13', 'image header', w::VARCHAR, h::VARCHAR, '8', '6', '0', (w * h)::VARCHAR, (w * h * 4)::VARCHAR]) AS value FROM (SELECT max(x) + 1 AS w, max(y) + 1 AS h FROM " + C.EVENTS_SQL + ")",
)


def _chunk(kind: bytes, body: bytes, crc: int | None = None) -> bytes:
    return len(body).to_bytes(4, "big") + kind + body + (zlib.crc32(kind + body) if crc is None else crc).to_bytes(4, "big")


_MAGIC = b"\x89PNG\r\n\x1a\n"


def _ihdr(w: int, h: int, depth: int = 8, colour: int = 2, inter: int = 0) -> bytes:
    return _chunk(b"IHDR", w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([depth, colour, 0, 0, inter]))


_IDAT, _IEND = _chunk(b"IDAT", zlib.compress(b"\0\0\0\0")), _chunk(b"IEND", b"")
#: Broken files, and the warnings and notes that each must have.
_BROKEN: dict[str, tuple[bytes, list[str]]] = {
    "bad_crc": (_MAGIC + _ihdr(1, 1) + _chunk(b"IDAT", b"", 1) + _IEND, [f"CRC is 00000001, computed {zlib.crc32(b'IDAT'):08x}"]),
    "no_end": (_MAGIC + _ihdr(1, 1) + _IDAT, ["no IEND chunk"]),
    "after_end": (_MAGIC + _ihdr(1, 1) + _IDAT + _IEND + b"hidden", ["6 bytes after IEND"]),
    "empty_image": (_MAGIC + _ihdr(0, 1) + _IDAT + _IEND, ["the image is empty"]),
    "bad_depth": (_MAGIC + _ihdr(1, 1, 4, 2) + _IDAT + _IEND, ["bit depth 4 isn't allowed with colour type 2"]),
    "huge": (_MAGIC + _ihdr(40_000, 40_000) + _IDAT + _IEND, ["more pixels are declared than any real image has"]),
    "interlaced": (_MAGIC + _ihdr(1, 1, inter=1) + _IDAT + _IEND, ["interlaced though only a few rows high"]),
    "late_palette": (_MAGIC + _ihdr(1, 1) + _IDAT + _chunk(b"PLTE", b"abc") + _IEND, ["the palette comes after image data"]),
    "odd_palette": (_MAGIC + _ihdr(1, 1) + _chunk(b"PLTE", b"abcd") + _IDAT + _IEND, ["palette length isn't a multiple of 3 up to 768"]),
    "no_palette": (_MAGIC + _ihdr(1, 1, 8, 3) + _IDAT + _IEND, ["indexed colour without a palette"]),
    "long_trns": (_MAGIC + _ihdr(1, 1) + _chunk(b"tRNS", bytes(300)) + _IDAT + _IEND, ["more transparency than a palette has entries"]),
    "full_end": (_MAGIC + _ihdr(1, 1) + _IDAT + _chunk(b"IEND", b"x"), ["the end chunk isn't empty"]),
    "private": (_MAGIC + _ihdr(1, 1) + _chunk(b"vpAg", b"x") + _IDAT + _IEND, ["ancillary unknown chunk", "the chunk type is a private one"]),
    "reserved": (_MAGIC + _ihdr(1, 1) + _chunk(b"tExt", b"a\0b") + _IDAT + _IEND, ["the reserved bit of the chunk type is set"]),
    "cut_chunk": (_MAGIC + _ihdr(1, 1) + _IDAT[:-3], ["chunk 'IDAT' at 33 declares %d bytes but the file ends" % (len(_IDAT) - 12), "no IDAT chunk", "no IEND chunk"]),
    "jpeg_plain": (bytes.fromhex("FFD8FFD9"), []),
    "jpeg_no_end": (bytes.fromhex("FFD8FFFE000461 62".replace(" ", "")), ["no EOI marker"]),
    "jpeg_second_start": (bytes.fromhex("FFD8FFD8FFD9"), ["a second start of image"]),
    "jpeg_restart": (bytes.fromhex("FFD8FFD3FFD9"), ["a restart marker outside a scan"]),
    "jpeg_stuffed": (bytes.fromhex("FFD8FF00FFD9"), ["a stuffed zero outside a scan"]),
    "jpeg_trailing": (bytes.fromhex("FFD8FFD9") + b"abc", ["3 bytes after EOI"]),
    "jpeg_short": (bytes.fromhex("FFD8FFFE0001FFD9"), ["segment length 1 is below 2"]),
    "jpeg_empty_frame": (bytes.fromhex("FFD8FFC0000B0800000001010111 00FFD9".replace(" ", "")), ["the frame is empty"]),
    "unknown": (b"plain", ["no structure is known for this format"]),
}


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spark.createDataFrame([(k, v) for k, (v, _) in _BROKEN.items()], "path string, content binary")
    return structure.report(files).where("kind IN ('warn', 'note')").select("path", F.col("label").alias("finding"))


_add("structure_findings", _findings, "SELECT * FROM (VALUES " + ", ".join(f"({_text(k)}, {_text(x)})" for k, (_, xs) in _BROKEN.items() for x in xs) + ") t(path, finding)")


def _findings_by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry.register(spark)
    spark.createDataFrame([(k, v) for k, (v, _) in _BROKEN.items()], "path string, content binary").createOrReplaceTempView("sift_broken")
    return spark.sql("SELECT path, count_if(kind IN ('warn', 'note')) AS findings FROM sift_broken, LATERAL sift_structure(content) GROUP BY path")


_add("udtf_structure", _findings_by_sql, "SELECT * FROM (VALUES " + ", ".join(f"({_text(k)}, CAST({len(xs)} AS BIGINT))" for k, (_, xs) in _BROKEN.items()) + ") t(path, findings)")

# -- symbols ------------------------------------------------------------------------------------------------

_PARTS = "(SELECT conv_id, turn - lo AS idx, hi - lo + 1 AS total, text FROM conversations JOIN (SELECT conv_id, min(turn) AS lo, max(turn) AS hi FROM conversations GROUP BY 1) USING (conv_id) WHERE NOT (conv_id % 5 = 0 AND turn = lo + 1))"
_add(
    "append_available", lambda s, d: symbols.merge_available(C.parts(s, d)).select("append_parity", "append_total", "have", F.concat_ws(",", F.col("missing").cast("array<string>")).alias("missing"), F.sha2("payload", 256).alias("sha256"), F.sha2("text", 256).alias("text_sha256")),
    f"WITH p AS (SELECT * FROM {_PARTS} WHERE idx < 16), g AS (SELECT conv_id, total, count(*) AS have, list(idx) AS got, string_agg(text, '' ORDER BY idx) AS text FROM p GROUP BY 1, 2) "
    "SELECT CAST(conv_id AS INTEGER) AS append_parity, CAST(total AS INTEGER) AS append_total, CAST(have AS INTEGER) AS have, array_to_string(list_filter(range(least(total, 16)), lambda i: NOT list_contains(got, i)), ',') AS missing, sha256(text) AS sha256, sha256(text) AS text_sha256 FROM g",
)


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("hit_no")
    hits = C.hits(spark, sf_dir)
    body = F.when(i % 3 == 0, F.encode(F.concat(F.lit("GIF89a"), "text"), "UTF-8")).when(i % 3 == 1, F.lit(b""))
    return hits.withColumn("payload", body).withColumn("text", F.when(i % 5 != 0, F.repeat("text", 6))).withColumn("append_total", F.when(i % 4 == 0, F.lit(3))).withColumn("append_index", F.when(i % 4 == 0, (i % 3).cast("int"))).withColumn("rotation", (i % 2 * 90).cast("int")).withColumn("inverted", i % 7 == 0)


_REPORTS = "(SELECT 'u' || user_id AS image_id, event_id AS i, CASE WHEN event_id % 3 = 0 THEN 'GIF89a' || event_type END AS payload, CASE WHEN event_id % 5 <> 0 THEN repeat(event_type, 6) END AS text FROM events)"
# the payload is built from the type's own name, the text is six times that
_add(
    "hit_labels", lambda s, d: symbols.label(_reports(s, d)).select("hit_no", "text_only", "label", "list_label"),
    "SELECT CAST(i AS INTEGER) AS hit_no, payload IS NULL AND text IS NOT NULL AS text_only, 'QR_CODE: ' || CASE WHEN payload IS NOT NULL THEN 'GIF image' WHEN text IS NOT NULL THEN 'text only' ELSE 'empty' END AS label, "
    "concat_ws('; ', 'QR_CODE', CASE WHEN payload IS NOT NULL THEN octet_length(encode(payload)) || ' bytes, GIF image' WHEN text IS NOT NULL THEN 'text ' || CASE WHEN length(text) > 40 THEN text[1:40] || '…' ELSE text END END, CASE WHEN i % 4 = 0 THEN 'part ' || (i % 3 + 1) || ' of 3' END, CASE WHEN i % 2 = 1 THEN 'turned 90' END, CASE WHEN i % 7 = 0 THEN 'inverted' END) AS list_label "
    f"FROM {_REPORTS}",
)
_add(
    "hit_summary", lambda s, d: symbols.summary(_reports(s, d)),
    "SELECT 'u' || user_id AS image_id, count(*) AS symbols, count(*) FILTER (event_id % 3 = 0) AS \"binary\", count(*) FILTER (event_id % 4 = 0) AS parts FROM events GROUP BY 1",
)
_add(
    "segments_joined", lambda s, d: C.table(s, d, "nation").select("n_nationkey", F.hex(symbols.join_segments(F.when(F.col("n_nationkey") % 4 == 0, F.array().cast("array<binary>")).otherwise(F.array(F.col("n_name").cast("binary"), F.lit(b"\x00"), F.col("n_regionkey").cast("string").cast("binary"))))).alias("hex")),
    "SELECT n_nationkey, CASE WHEN n_nationkey % 4 <> 0 THEN hex(encode(n_name)) || '00' || hex(encode(n_regionkey::VARCHAR)) END AS hex FROM nation",
)


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
