"""The library's own queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelsift import queries_small, selfcheck
from pixelsift.functions import pixels as P
from pixelsift.functions import regions
from pixelsift.model import CHANNELS, FLAG_NAMES, LAST_SIGNATURES, LATER_SIGNATURES, RANDOM_MAPS, SIGNATURES, transforms
from pixelsift.operators import extract as X
from pixelsift.operators import grids, hexdump, lsbscan, payload, symbols, symbolscan
from pixelsift.plans import carriers as C
from pixelsift.sinks import writers
from pixelsift.sources import images, structure

_Q: dict = {}
_SQL: dict[str, str] = {}


def _add(name: str, query, sql: str | None = None) -> None:
    _Q[name] = query
    if sql:
        _SQL[name] = sql


# -- transforms ---------------------------------------------------------------------------------------------

_OPAQUE = "4278190080"


def _channel_sql(name: str, argb: str = "argb") -> str:
    return f"(({argb} >> {CHANNELS[name]}) & 255)"


def _transform_sql(kind: str, channel: str | None, number: int | None) -> str:
    if kind == "original":
        return "argb"
    if kind == "invert":
        return f"(xor(argb, 16777215) & 16777215) + {_OPAQUE}"
    if kind == "plane":
        return f"CASE WHEN (argb >> {CHANNELS[channel] + number}) & 1 = 1 THEN 4294967295 ELSE {_OPAQUE} END"
    if kind == "full":
        return f"{_OPAQUE} + {_channel_sql(channel)} * {65536 if channel == 'alpha' else 1 << CHANNELS[channel]}"
    if kind == "map":
        bm, ba, bx, gm, ga, gx, rm, ra, rx = RANDOM_MAPS[number]
        one = lambda c, m, a, x: f"(xor({_channel_sql(c)} * {m * m}, {x}) + {a})"
        return f"(({one('red', rm, ra, rx)} * 65536 + {one('green', gm, ga, gx)} * 256 + {one('blue', bm, ba, bx)}) & 16777215) + {_OPAQUE}"
    return f"CASE WHEN {_channel_sql('red')} = {_channel_sql('green')} AND {_channel_sql('green')} = {_channel_sql('blue')} THEN 4294967295 ELSE {_OPAQUE} END"


def _transform_name(kind: str, channel: str | None, number: int | None) -> str:
    return {"plane": f"plane_{channel}_{number}", "full": f"full_{channel}", "map": f"random_map_{number}"}.get(kind, kind)


for _i, _kind, _ch, _n, _ in transforms():
    _add(
        f"transform_{_transform_name(_kind, _ch, _n)}",
        lambda s, d, i=_i: grids.apply(C.events_px(s, d), i).select("x", "y", "argb"),
        f"SELECT x, y, CAST({_transform_sql(_kind, _ch, _n)} AS BIGINT) AS argb FROM {C.EVENTS_SQL}",
    )


def _palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return C.table(spark, sf_dir, "nation").select(F.lit("customers").alias("image_id"), k.alias("pal_idx"), F.pmod(k.cast("long") * 10368889 + 4278190080, F.lit(1 << 32)).alias("argb"))


def _palette_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    px = C.table(spark, sf_dir, "customer").select(F.lit("customers").alias("image_id"), (k % 40).cast("int").alias("x"), F.floor(k / 40).cast("int").alias("y"), (F.col("c_nationkey") + k % 3).cast("int").alias("pal_idx"))
    return grids.palette_map(px, _palette(spark, sf_dir)).select("x", "y", "argb")


_add(
    "transform_palette_map", _palette_query,
    "WITH p AS (SELECT n_nationkey AS i, (CAST(n_nationkey AS BIGINT) * 10368889 + 4278190080) % 4294967296 AS argb FROM nation) "
    "SELECT CAST(c_custkey % 40 AS INTEGER) AS x, CAST(c_custkey // 40 AS INTEGER) AS y, CAST(p.argb AS BIGINT) AS argb FROM customer JOIN p ON p.i = least(c_nationkey + c_custkey % 3, (SELECT max(i) FROM p))",
)
_add(
    "pixel_inspector", lambda s, d: C.events_px(s, d).select("x", "y", P.argb_hex(F.col("argb")).alias("hex"), P.bit_planes(F.col("argb")).alias("bits")),
    f"SELECT x, y, '#' || upper(lpad(to_hex(argb), 8, '0')) AS hex, b[1:8] || ' ' || b[9:16] || ' ' || b[17:24] || ' ' || b[25:32] AS bits FROM (SELECT x, y, argb, lpad(bin(argb), 32, '0') AS b FROM {C.EVENTS_SQL})",
)

# -- combination --------------------------------------------------------------------------------------------


def _each(f) -> str:
    r, g, b = (f(_channel_sql(c, "a"), _channel_sql(c, "b")) for c in ("red", "green", "blue"))
    return f"({r}) * 65536 + ({g}) * 256 + ({b})"


_BLENDS = {
    "xor": "xor(a, b)", "or": "(a | b)", "and": "(a & b)", "add": "((a + b) & 16777215)", "sub": "((a - b + 16777216) % 16777216)", "mul": "((a * b) % 16777216)",
    "add_ch": _each(lambda x, y: f"({x} + {y}) & 255"), "sub_ch": _each(lambda x, y: f"({x} - {y} + 256) % 256"), "mul_ch": _each(lambda x, y: f"({x} * {y}) & 255"),
    "light": _each(lambda x, y: f"greatest({x}, {y})"), "dark": _each(lambda x, y: f"least({x}, {y})"),
}
for _mode, _sql in _BLENDS.items():
    _add(
        f"combine_{_mode}", lambda s, d, m=_mode: grids.blend(C.events_px(s, d), C.orders_px(s, d), m, "combined").select("x", "y", "argb"),
        f"WITH e AS (SELECT * FROM {C.EVENTS_SQL}), o AS (SELECT * FROM {C.ORDERS_SQL}), g AS (SELECT CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y FROM range((SELECT greatest((SELECT max(x) FROM e), (SELECT max(x) FROM o)) + 1)) r(x), range((SELECT greatest((SELECT max(y) FROM e), (SELECT max(y) FROM o)) + 1)) q(y)), "
        f"j AS (SELECT g.x, g.y, coalesce(e.argb, 0) & 16777215 AS a, coalesce(o.argb, 0) & 16777215 AS b FROM g LEFT JOIN e ON e.x = g.x AND e.y = g.y LEFT JOIN o ON o.x = g.x AND o.y = g.y) "
        f"SELECT x, y, CAST({_sql} + {_OPAQUE} AS BIGINT) AS argb FROM j",
    )
for _axis, _name in (("y", "rows"), ("x", "cols")):
    _tw = lambda c, t, a=_axis: f"CAST({c} * 2 + {t} AS INTEGER) AS {c}" if c == a else c
    _half = lambda sql, t: f"SELECT {_tw('x', t)}, {_tw('y', t)}, (argb & 16777215) + {_OPAQUE} AS argb FROM {sql}, m WHERE x < w AND y < h"
    _add(
        f"interlace_{_name}", lambda s, d, a=_axis: grids.interlace(C.events_px(s, d), C.orders_px(s, d), a, "combined").select("x", "y", "argb"),
        f"WITH m AS (SELECT least((SELECT max(x) FROM {C.EVENTS_SQL}), (SELECT max(x) FROM {C.ORDERS_SQL})) + 1 AS w, least((SELECT max(y) FROM {C.EVENTS_SQL}), (SELECT max(y) FROM {C.ORDERS_SQL})) + 1 AS h) {_half(C.EVENTS_SQL, 0)} UNION ALL {_half(C.ORDERS_SQL, 1)}",
    )

# -- stereograms --------------------------------------------------------------------------------------------

for _name, _source, _f in (("stereo_xor", "(p.x + 37) % w", grids.stereo_xor), ("stereo_edge_hold", "least(p.x + 37, w - 1)", grids.stereo_edge_hold)):
    _add(
        _name, lambda s, d, f=_f: f(C.events_px(s, d), 37).select("x", "y", "argb"),
        f"WITH p AS (SELECT * FROM {C.EVENTS_SQL}), s AS (SELECT max(x) + 1 AS w FROM p) SELECT p.x, p.y, CAST((xor(p.argb, q.argb) & 16777215) + {_OPAQUE} AS BIGINT) AS argb FROM p, s JOIN p q ON q.y = p.y AND q.x = {_source}".replace("FROM p, s JOIN p q ON", "FROM p CROSS JOIN s JOIN p q ON"),
    )
_add(
    "stereo_best_offset", lambda s, d: grids.stereo_best_offset(C.periodic_px(s, d)).select("offset", "matches"),
    f"WITH p AS (SELECT * FROM {C.PERIODIC_SQL}), s AS (SELECT max(x) + 1 AS w FROM p) SELECT CAST(o AS INTEGER) AS \"offset\", CAST(count(*) FILTER (p.argb = q.argb) AS BIGINT) AS matches FROM p CROSS JOIN s JOIN range(1, 10000) r(o) ON o <= w // 2 JOIN p q ON q.y = p.y AND q.x = p.x + o WHERE p.x % 4 = 0 AND p.y % 4 = 0 GROUP BY o ORDER BY 2 DESC, 1 LIMIT 1",
)

def _square(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upper hundred rows of the events carrier: the picture of which a thumbnail is made."""
    return grids.crop(C.events_px(spark, sf_dir), 0, 0, C.EVENTS_WIDTH, 100)


# -- geometry -----------------------------------------------------------------------------------------------

_add("roi_crop", lambda s, d: grids.crop(C.events_px(s, d), 7, 5, 40, 4).select("x", "y", "argb"), f"SELECT CAST(x - 7 AS INTEGER) AS x, CAST(y - 5 AS INTEGER) AS y, argb FROM {C.EVENTS_SQL} WHERE x BETWEEN 7 AND 46 AND y BETWEEN 5 AND 8")
for _turns, _x, _y in ((1, "y", "w - 1 - x"), (2, "w - 1 - x", "h - 1 - y"), (3, "h - 1 - y", "x")):
    _add(
        f"rotate_{90 * _turns}", lambda s, d, t=_turns: grids.rotate(C.events_px(s, d), t).select("x", "y", "argb"),
        f"SELECT CAST({_x} AS INTEGER) AS x, CAST({_y} AS INTEGER) AS y, argb FROM {C.EVENTS_SQL}, (SELECT max(x) + 1 AS w, max(y) + 1 AS h FROM {C.EVENTS_SQL})",
    )
for _name, _factor in (("2x", 2.0), ("half", 0.5), ("third", 1 / 3), ("thumbnail", 0.64)):
    _add(
        f"scale_{_name}", lambda s, d, f=_factor, n=_name: (grids.thumbnail(_square(s, d), 64) if n == "thumbnail" else grids.scale(C.events_px(s, d), f)).select("x", "y", "argb"),
        f"WITH p AS (SELECT * FROM {C.EVENTS_SQL} {'WHERE y < 100' if _name == 'thumbnail' else ''}), s AS (SELECT max(x) + 1 AS w, max(y) + 1 AS h FROM p), g AS (SELECT CAST(a AS INTEGER) AS nx, CAST(b AS INTEGER) AS ny, w, h FROM s, range(1000) r(a), range(100000) q(b) WHERE a < greatest(1, floor(w * {_factor} + 0.5)) AND b < greatest(1, floor(h * {_factor} + 0.5))) "
        f"SELECT nx AS x, ny AS y, argb FROM g JOIN p ON p.x = least(w - 1, floor(nx / {_factor})) AND p.y = least(h - 1, floor(ny / {_factor}))",
    )


def _over(c: str, rounding: int) -> str:
    return f"(({_channel_sql(c)} * {_channel_sql('alpha')} + (255 - {_channel_sql('alpha')}) * 255 + {rounding}) // 255)"


_LUMA = f"(({_over('red', 0)} * 306 + {_over('green', 0)} * 601 + {_over('blue', 0)} * 117) >> 10)"
_add("luminance", lambda s, d: grids.luminance(C.events_px(s, d)).select("x", "y", "luminance"), f"SELECT x, y, CAST({_LUMA} AS INTEGER) AS luminance FROM {C.EVENTS_SQL}")
_add("luminance_inverted", lambda s, d: grids.luminance(C.events_px(s, d), True).select("x", "y", "luminance"), f"SELECT x, y, CAST(255 - {_LUMA} AS INTEGER) AS luminance FROM {C.EVENTS_SQL}")
_add("flatten_white", lambda s, d: C.events_px(s, d).select("x", "y", P.flatten_white(F.col("argb")).alias("argb")), f"SELECT x, y, CAST({_OPAQUE} + {_over('red', 127)} * 65536 + {_over('green', 127)} * 256 + {_over('blue', 127)} AS BIGINT) AS argb FROM {C.EVENTS_SQL}")

# -- extraction ---------------------------------------------------------------------------------------------


def _extract_sql(cfg: X.Config, roi: tuple | None = None, max_bytes: int | None = None) -> str:
    bits = cfg.bits()
    px = C.EVENTS_SQL
    if roi:
        x, y, w, h = roi
        px = f"(SELECT CAST(x - {x} AS INTEGER) AS x, CAST(y - {y} AS INTEGER) AS y, argb FROM {C.EVENTS_SQL} WHERE x BETWEEN {x} AND {x + w - 1} AND y BETWEEN {y} AND {y + h - 1})"
    rank = "y * w + x" if cfg.row_first else "x * h + y"
    planes = ", ".join(f"({i}, {b})" for i, b in enumerate(bits))
    value = "1 - ((argb >> b) & 1)" if cfg.invert else "(argb >> b) & 1"
    bound = f"WHERE pos < {8 * max_bytes}" if max_bytes is not None else ""
    return (
        f"WITH p AS (SELECT * FROM {px}), s AS (SELECT max(x) + 1 AS w, max(y) + 1 AS h FROM p), b AS (SELECT CAST({rank} AS BIGINT) * {len(bits)} + i AS pos, {value} AS bit FROM p, s, (VALUES {planes}) v(i, b)) "
        f"SELECT CAST(pos // 8 AS BIGINT) AS byte_idx, CAST(sum(bit << CAST(7 - pos % 8 AS INTEGER)) AS INTEGER) AS value FROM b {bound} GROUP BY 1"
    )


for _name, _cfg, _roi, _most in (
    ("rgb_lsb", X.RGB_LSB, None, None),
    ("all_planes", X.ALL_PLANES, None, None),
    ("col_msb_bgr_inv", X.config("RGB", [0, 1], order="BGR", row_first=False, invert=True), None, None),
    ("roi", X.config("RG", [0, 2], lsb_first=True), (3, 2, 31, 5), None),
    ("prefix", X.config("ARGB", [0, 7], order="GBR"), None, 333),
):
    _add(f"extract_{_name}", lambda s, d, c=_cfg, r=_roi, m=_most: X.extract_bits(C.events_px(s, d), c, r, m).select("byte_idx", "value"), _extract_sql(_cfg, _roi, _most))

# -- payloads -----------------------------------------------------------------------------------------------

_HEX = "hex(data)"
_BAD_ASCII = f"regexp_matches({_HEX}, '^(..)*(0[0-8BCEF]|1.|7F|[89A-F].)')"
_CONTROL = f"regexp_matches({_HEX}, '^(..)*(0[0-8BCEF]|1.)')"
_BASE64 = f"(octet_length(data) >= 8 AND octet_length(data) % 4 = 0 AND regexp_matches(coalesce(try(decode(data)), ' '), '^[A-Za-z0-9+/\\r\\n]*={{0,2}}$') AND NOT regexp_matches(coalesce(try(decode(data)), ' '), '=[\\r\\n]'))"


def _starts_sql(pairs) -> str:
    return " ".join(f"WHEN {_HEX} LIKE '{h}%' THEN '{n}'" for h, n in pairs)


_TYPE = (
    f"CASE WHEN octet_length(data) = 0 THEN 'EMPTY' {_starts_sql(SIGNATURES)} WHEN octet_length(data) > 262 AND substr({_HEX}, 515, 10) = '7573746172' THEN 'TAR' {_starts_sql(LATER_SIGNATURES)} "
    f"WHEN {_HEX} LIKE '52494646________57454250%' THEN 'WEBP' {_starts_sql(LAST_SIGNATURES)} WHEN NOT {_BAD_ASCII} THEN CASE WHEN {_BASE64} THEN 'BASE64_TEXT' ELSE 'TEXT_ASCII' END "
    f"WHEN try(decode(data)) IS NOT NULL AND NOT {_CONTROL} THEN 'TEXT_UTF8' ELSE 'BINARY' END"
)
_add("payload_type", lambda s, d: C.payloads(s, d).select("payload_id", payload.payload_type(F.col("data")).alias("payload_type")), f"SELECT payload_id, {_TYPE} AS payload_type FROM {C.PAYLOADS_SQL}")
_add("payload_base64", lambda s, d: C.payloads(s, d).select("payload_id", payload.is_base64(F.col("data")).alias("is_base64")), f"SELECT payload_id, {_BASE64} AS is_base64 FROM {C.PAYLOADS_SQL}")
_add("payload_sha256", lambda s, d: C.payloads(s, d).select("payload_id", F.sha2("data", 256).alias("sha256")), f"SELECT payload_id, sha256(data) AS sha256 FROM {C.PAYLOADS_SQL}")


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = payload.classify(C.payloads(spark, sf_dir))
    return c.select("payload_id", F.col("size").cast("long").alias("size"), F.round(F.col("entropy") + 0.0, 6).alias("entropy"), "distinct_bytes", F.round("normalised_entropy", 6).alias("normalised_entropy"), "packed")


_HISTOGRAM = (
    f"p AS (SELECT payload_id, data, octet_length(data) AS n FROM {C.PAYLOADS_SQL}), b AS (SELECT payload_id, unnest(regexp_extract_all(hex(data), '..')) AS v FROM p), h AS (SELECT payload_id, v, count(*) AS k FROM b GROUP BY ALL), "
    "e AS (SELECT p.payload_id, p.n, coalesce(-sum((k / n) * log2(k / n)), 0.0) AS ent, count(v) AS dist, coalesce(sum(k) FILTER (v BETWEEN '20' AND '7E'), 0) AS printable, coalesce(sum(k) FILTER (v IN ('20', '09')), 0) AS blanks FROM p LEFT JOIN h USING (payload_id) GROUP BY ALL)"
)
_NORMAL = "CASE WHEN n < 2 THEN 0.0 ELSE least(1.0, (ent + (dist - 1) / (2.0 * n * ln(2))) / log2(least(256, n))) END"
_add(
    "payload_stats", _stats,
    f"WITH {_HISTOGRAM} SELECT payload_id, CAST(n AS BIGINT) AS size, round(ent + 0.0, 6) AS entropy, CAST(dist AS INTEGER) AS distinct_bytes, round({_NORMAL}, 6) AS normalised_entropy, n >= 96 AND {_NORMAL} > 0.9 AS packed FROM e",
)
_FLAG = "regexp_extract(head, '(?i)(" + FLAG_NAMES + ")\\{[\\x20-\\x7E]{1,128}?\\}')"
_HEAD = "array_to_string(list_transform(regexp_extract_all(substr(hex(data), 1, 32768), '..'), lambda v: CASE WHEN v BETWEEN '20' AND '7E' THEN decode(from_hex(v)) ELSE chr(1) END), '')"
_add(
    "flag_search", lambda s, d: C.payloads(s, d).select("payload_id", payload.flag(F.col("data")).alias("flag")),
    f"SELECT payload_id, CASE WHEN octet_length(data) >= 5 AND {_FLAG} <> '' THEN {_FLAG} END AS flag FROM (SELECT payload_id, data, {_HEAD} AS head FROM {C.PAYLOADS_SQL})",
)
_SURE = "('ZIP','SEVEN_ZIP','RAR','GZIP','BZIP2','XZ','TAR','PNG','JPEG','GIF','WEBP','PDF','ELF','JAVA_CLASS')"
_add(
    "payload_score", lambda s, d: payload.classify(C.payloads(s, d)).select("payload_id", "score"),
    f"WITH {_HISTOGRAM}, t AS (SELECT payload_id, data, {_TYPE} AS kind, {_HEAD} AS head FROM {C.PAYLOADS_SQL}) SELECT payload_id, CAST(CASE WHEN n = 0 THEN 0 WHEN dist = 1 THEN 1 WHEN n >= 5 AND {_FLAG} <> '' THEN 98 WHEN kind IN {_SURE} THEN 100 WHEN kind = 'BMP' THEN CASE WHEN n >= 14 THEN 95 ELSE 80 END WHEN kind = 'PE' THEN 65 "
    "WHEN kind = 'BASE64_TEXT' THEN CASE WHEN n >= 24 THEN 72 ELSE 45 END WHEN kind IN ('TEXT_ASCII', 'TEXT_UTF8') THEN CASE WHEN blanks > 0 AND printable / n > 0.9 THEN 90 WHEN printable / n > 0.95 THEN 86 ELSE 80 END "
    "WHEN hex(data) LIKE '2321%' THEN 94 WHEN regexp_matches(hex(data), '^(20|09|0A|0D)*(7B|5B)(([2-9A-F].|09|0A|0D){63}|([2-9A-F].|09|0A|0D)*$)') AND n >= 2 THEN 92 WHEN regexp_matches(head, '(?i)^ *<([?]xml|!doctype|html|svg)') THEN 92 "
    "WHEN printable / n > 0.7 THEN 65 WHEN dist < 5 THEN 5 WHEN ent > 7.6 THEN 15 WHEN dist >= 16 AND ent BETWEEN 3 AND 7 THEN 30 ELSE 20 END AS INTEGER) AS score FROM t JOIN e USING (payload_id)",
)
_add("payload_notes", lambda s, d: C.payloads(s, d).select("payload_id", F.array_join(payload.payload_notes("data", payload.payload_type(F.col("data"))), "; ").alias("notes")))

# -- search -------------------------------------------------------------------------------------------------


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.to_packed(C.stego_px(spark, sf_dir))


_add("lsb_scan_ranked", lambda s, d: lsbscan.scan(_packed(s, d)).select("image_id", "rank", "opt_idx", "score", "reason", "payload_type", "sha256", "total_bytes", "truncated"))
_add("lsb_scan_deep", lambda s, d: lsbscan.scan(_packed(s, d), deep=True).select("image_id", "rank", "opt_idx", "score", "reason", "payload_type", "sha256", "total_bytes", "truncated"))

# -- dumps --------------------------------------------------------------------------------------------------

_add(
    "hex_dump", lambda s, d: hexdump.dump(C.payloads(s, d), "payload_id"),
    f"WITH l AS (SELECT payload_id, hex(data) AS h, octet_length(data) AS n, unnest(range(CAST(ceil(octet_length(data) / 16.0) AS BIGINT))) AS i FROM {C.PAYLOADS_SQL}), p AS (SELECT payload_id, i, lower(substr(h, CAST(i * 32 + 1 AS BIGINT), 32)) AS part FROM l), "
    "t AS (SELECT *, array_to_string(list_transform(regexp_extract_all(part, '..'), lambda v: CASE WHEN v BETWEEN '20' AND '7e' THEN decode(from_hex(v)) ELSE '.' END), '') AS c FROM p) "
    "SELECT payload_id, CAST(i AS INTEGER) AS line_no, lpad(to_hex(i * 16), 8, '0') || '  ' || substr(rpad(part, 32, ' '), 1, 16) || ' ' || substr(rpad(part, 32, ' '), 17, 16) || '  ' || CASE WHEN length(c) >= 8 THEN c[1:8] || ' ' || c[9:] ELSE c END AS line FROM t".replace("to_hex(i * 16)", "lower(to_hex(i * 16))"),
)
_add("hex_compact", lambda s, d: C.payloads(s, d).select("payload_id", hexdump.hex_compact(F.col("data")).alias("hex")), f"SELECT payload_id, lower(hex(data)) AS hex FROM {C.PAYLOADS_SQL}")
_add("hex_spaced", lambda s, d: C.payloads(s, d).select("payload_id", hexdump.hex_spaced(F.col("data")).alias("hex")), f"SELECT payload_id, array_to_string(regexp_extract_all(lower(hex(data)), '..'), ' ') AS hex FROM {C.PAYLOADS_SQL}")

# -- symbols ------------------------------------------------------------------------------------------------

_PARTS = (
    "(SELECT conv_id, turn - lo AS idx, hi - lo + 1 AS total, text FROM conversations JOIN (SELECT conv_id, min(turn) AS lo, max(turn) AS hi FROM conversations GROUP BY 1) USING (conv_id) WHERE NOT (conv_id % 5 = 0 AND turn = lo + 1))"
)
_MERGED = (
    f"WITH s AS (SELECT conv_id, total, idx, min(text) AS text, count(*) AS n, min(text) = max(text) AS same FROM {_PARTS} GROUP BY conv_id, total, idx), m AS (SELECT conv_id, total, sum(n) AS n_parts, total - count(*) AS missing, bool_and(same) AND count(*) = total AND total <= 16 AS complete, string_agg(text, '' ORDER BY idx) AS text FROM s GROUP BY conv_id, total) "
    "SELECT CAST(conv_id AS INTEGER) AS append_parity, CAST(total AS INTEGER) AS append_total, CAST(n_parts AS BIGINT) AS n_parts, CAST(missing AS BIGINT) AS missing, complete, CASE WHEN complete THEN sha256(text) END AS sha256 FROM m"
)


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.merge_parts(C.parts(spark, sf_dir)).select("append_parity", "append_total", "n_parts", "missing", "complete", F.sha2("payload", 256).alias("sha256"))


_add("append_merge", _merged, _MERGED)
_add("append_incomplete", lambda s, d: _merged(s, d).where("NOT complete"), f"SELECT * FROM ({_MERGED}) WHERE NOT complete")
_add(
    "hit_pairs", lambda s, d: symbols.same_symbol_pairs(C.hits(s, d)),
    f'WITH h AS (SELECT * FROM {C.HITS_SQL}) SELECT a.image_id, a.hit_no AS "first", b.hit_no AS "second" FROM h a JOIN h b ON a.image_id = b.image_id AND a.text = b.text AND a.hit_no < b.hit_no WHERE a.text <> \'\' AND (NOT a.located OR NOT b.located OR sqrt((a.bx - b.bx) ** 2 + (a.by_ - b.by_) ** 2) <= 12)',
)
_FOLDED = "list_reduce(list([p] ORDER BY p.hit_no), lambda kept, one: CASE WHEN len(list_filter(kept, lambda k: sqrt((k.bx - one[1].bx) ** 2 + (k.by_ - one[1].by_) ** 2) <= 12)) > 0 THEN kept ELSE kept || one END)"
_add(
    "hit_dedupe", lambda s, d: symbols.deduplicate(C.hits(s, d)).select("image_id", "hit_no", "text", "located"),
    f"WITH h AS (SELECT * FROM {C.HITS_SQL} WHERE text <> ''), p AS (SELECT image_id, text, {{'hit_no': hit_no, 'bx': bx, 'by_': by_}} AS p FROM h WHERE located), "
    f"f AS (SELECT image_id, text, unnest({_FOLDED}) AS k FROM p GROUP BY image_id, text) SELECT image_id, k.hit_no AS hit_no, text, true AS located FROM f "
    "UNION ALL SELECT image_id, min(hit_no), text, false FROM h GROUP BY image_id, text HAVING NOT bool_or(located) UNION ALL "
    f"SELECT image_id, hit_no, text, located FROM {C.HITS_SQL} WHERE coalesce(text, '') = ''",
)

# -- files --------------------------------------------------------------------------------------------------


def _files(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return writers.encoded(images.to_packed(C.events_px(spark, sf_dir)), kind).select(F.col("image_id").alias("path"), "content")


for _kind, _value in (("png", "argb"), ("bmp", f"CAST({_OPAQUE} + {_over('red', 127)} * 65536 + {_over('green', 127)} * 256 + {_over('blue', 127)} AS BIGINT)")):
    _add(f"structure_{_kind}", lambda s, d, k=_kind: structure.report(_files(s, d, k)))
    _add(f"round_trip_{_kind}", lambda s, d, k=_kind: images.to_long(images.read_images(_files(s, d, k)).withColumnRenamed("path", "image_id")).select("x", "y", "argb"), f"SELECT x, y, {_value} AS argb FROM {C.EVENTS_SQL}")


def _round_trip(spark: SparkSession, sf_dir: str, kind: str, mask: int) -> DataFrame:
    px = C.events_px(spark, sf_dir).withColumn("argb", F.col("argb").bitwiseAND(F.lit(mask)).bitwiseOR(F.lit(~mask & 0xFF000000)))
    files = writers.encoded(images.to_packed(px), kind).select(F.col("image_id").alias("path"), "content")
    return images.to_long(images.read_images(files).withColumnRenamed("path", "image_id")).select("x", "y", "argb")


# TIFF keeps all bits; of GIF, 64 opaque colours
_add("round_trip_tiff", lambda s, d: _round_trip(s, d, "tiff", 0xFFFFFFFF), f"SELECT x, y, argb FROM {C.EVENTS_SQL}")
_add("round_trip_gif", lambda s, d: _round_trip(s, d, "gif", 0x00C0C0C0), f"SELECT x, y, CAST((argb & {0x00C0C0C0}) | {0xFF000000} AS BIGINT) AS argb FROM {C.EVENTS_SQL}")


# -- decoding -----------------------------------------------------------------------------------------------


def _drawn(spark: SparkSession, sf_dir: str, name: str, key: str, text: str, kind: str) -> DataFrame:
    rows = C.table(spark, sf_dir, name).select(F.col(key).cast("string").alias("image_id"), F.col(text).alias("text"))
    return symbolscan.scan_made(C.dealt(rows), C.drawing(kind)).select("image_id", "format", "text")


_add("qr_decode", lambda s, d: _drawn(s, d, "supplier", "s_suppkey", "s_name", "qr"), "SELECT CAST(s_suppkey AS VARCHAR) AS image_id, 'QR_CODE' AS format, s_name AS text FROM supplier")
_add("code128_decode", lambda s, d: _drawn(s, d, "nation", "n_nationkey", "n_name", "bars"), "SELECT CAST(n_nationkey AS VARCHAR) AS image_id, 'CODE_128' AS format, n_name AS text FROM nation")


def _drawn_bars(spark: SparkSession, sf_dir: str, kind: str, text: str) -> DataFrame:
    rows = C.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("image_id"), F.expr(text).alias("text"))
    return symbolscan.scan_made(C.dealt(rows), C.drawing(kind)).select("image_id", "format", "text")


def _checked(number: str, size: int) -> str:
    """The check digit of a number of so many digits, in SQL."""
    weighted = f"[CAST(({number})[i] AS INTEGER) * CASE WHEN ({size} - i) % 2 = 0 THEN 3 ELSE 1 END for i in range(1, {size + 1})]"
    return f"CAST((1000 - list_sum({weighted})) % 10 AS VARCHAR)"


_KEY = "lpad('' || s_suppkey, {}, '0')"
# what is drawn, and what is read beyond it, by format
for _kind, _text, _read in (
    ("EAN_13", "'4' || " + _KEY.format(11), "{t} || " + _checked("{t}", 12)), ("EAN_8", _KEY.format(7), "{t} || " + _checked("{t}", 7)),
    ("UPC_A", _KEY.format(11), "{t} || " + _checked("{t}", 11)), ("UPC_E", "'0' || " + _KEY.format(5) + " || '7'", "{t} || " + _checked("'0' || ({t})[2:6] || '00007'", 11)),
    ("CODE_39", "replace(upper(s_name), '#', '-')", "{t}"), ("ITF", _KEY.format(8), "{t}"), ("CODABAR", "'A' || s_suppkey || '-$' || s_nationkey || 'B'", "({t})[2:-2]"),
):
    _add(f"bars_{_kind.lower()}", lambda s, d, k=_kind, t=_text: _drawn_bars(s, d, k, t), f"SELECT CAST(s_suppkey AS VARCHAR) AS image_id, '{_kind}' AS format, {_read.replace('{t}', f'({_text})')} AS text FROM supplier")
_add(
    "region_algebra",
    lambda s, d: C.table(s, d, "nation").select("n_nationkey", *[regions.intersect(regions.region(F.col("n_nationkey"), 3, 9, F.col("n_regionkey") + 2), regions.region(5, F.col("n_regionkey"), 11, 7))[f].alias(f) for f in ("x", "y", "width", "height")]),
    "SELECT n_nationkey, CAST(greatest(n_nationkey, 5) AS INTEGER) AS x, CAST(greatest(3, n_regionkey) AS INTEGER) AS y, CAST(greatest(0, least(n_nationkey + 9, 16) - greatest(n_nationkey, 5)) AS INTEGER) AS width, CAST(greatest(0, least(n_regionkey + 5, n_regionkey + 7) - greatest(3, n_regionkey)) AS INTEGER) AS height FROM nation",
)
_add("self_check", lambda s, d: selfcheck.run(s).select("step", "passed"))


def queries() -> dict:
    return _Q | queries_small.queries()


def oracle_sql() -> dict[str, str]:
    return _SQL | queries_small.oracle_sql()
