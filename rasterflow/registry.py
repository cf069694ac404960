"""Registered queries of the raster engine, each with the same computation as SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterflow.functions import colour, gates, rng
from rasterflow.operators import render as R
from rasterflow.operators import stencil
from rasterflow.plans import graph
from rasterflow.sources import rasters

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

EV = """ev0 as (select cast(event_id as bigint) as i, cast(user_id as bigint) as u, event_type, value / 50.0 as r from events),
ev as (select cast(i // 100 as integer) as y, cast(i % 100 as integer) as x, r, r * (0.6 + 0.04 * (i % 11)) as g, r * (0.3 + 0.05 * (u % 13)) as b,
  case event_type when 'error' then 0.0 when 'signup' then 0.5 else 1.0 end as a, 100 as width, cast((select max(i) // 100 + 1 from ev0) as integer) as height from ev0)"""


#: Values of few digits often end in a 5 where they are rounded; this moves all of those the same way.
TIE = 2e-10


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Six digits, ties moved up, and no negative zero: what the comparison with SQL is made on."""
    return df.withColumns({c: F.round(F.col(c) + TIE, 6) + F.lit(0.0) for c in columns})


def sql_round(*pairs: str) -> str:
    return ", ".join(f"round({e} + {TIE}, 6) + 0.0 as {n}" for e, n in (p.rsplit(" as ", 1) for p in pairs))


def ss(a: str, b: str, x: str) -> str:
    t = f"least(1.0, greatest(0.0, (({x}) - ({a})) / (({b}) - ({a}))))"
    return f"({t} * {t} * (3 - 2 * {t}))"


Y709 = "(0.2126 * r + 0.7152 * g + 0.0722 * b)"
DEC = "case when {0} <= 0 then 0.0 when {0} <= 0.04045 then {0} / 12.92 else pow(({0} + 0.055) / 1.055, 2.4) end"
ENC = "case when {0} <= 0 then 0.0 when {0} <= 0.0031308 then {0} * 12.92 else 1.055 * pow({0}, 1 / 2.4) - 0.055 end"
LIN = f"lin as (select y, x, a, width, height, {', '.join(DEC.format(c) + ' as ' + c for c in 'rgb')} from ev)"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display values to linear light, masked by luma, gated by highlight: statistics of each frame."""
    df = colour.mapped(rasters.events_raster(spark, sf_dir), lambda v: colour.decode(v, "sRGB"))
    y = colour.luma()
    mask, gate = gates.luma_mask(y, -4, 2, 1.5), gates.smoothstep(0.72, 1.44, F.greatest("r", "g", "b"))
    return df.select("frame_id", y.alias("v"), mask.alias("m"), gate.alias("q")).groupBy("frame_id").agg(
        F.count("*").alias("pixels"), F.round(F.avg("v"), 6).alias("mean_luma"), F.round(F.max("v"), 6).alias("max_luma"),
        F.round(F.avg("m"), 6).alias("mean_mask"), F.round(F.avg("q"), 6).alias("mean_gate"))


_EV = f"(log2(greatest(pow(2.0, -24), {Y709}) / 0.18))"
query("frame_statistics", f"""with {EV}, {LIN} select 'ev' as frame_id, count(*) as pixels, round(avg({Y709}), 6) as mean_luma, round(max({Y709}), 6) as max_luma,
round(avg({ss('-5.5', '-4', _EV)} * (1 - {ss('2', '3.5', _EV)})), 6) as mean_mask, round(avg({ss('0.72', '1.44', 'greatest(r, g, b)')}), 6) as mean_gate from lin""")(flagship)


@query("colour_srgb_decode", f"with {EV} select y, x, {sql_round(*(DEC.format(c) + ' as ' + c for c in 'rgb'))} from ev")
def colour_srgb_decode(spark, sf_dir):
    return rounded(colour.mapped(rasters.events_raster(spark, sf_dir), lambda v: colour.decode(v, "sRGB")), *"rgb").select("y", "x", *"rgb")


@query("colour_srgb_encode", f"with {EV} select y, x, {sql_round(*(ENC.format(c) + ' as ' + c for c in 'rgb'))} from ev")
def colour_srgb_encode(spark, sf_dir):
    return rounded(colour.mapped(rasters.events_raster(spark, sf_dir), lambda v: colour.encode(v, "sRGB")), *"rgb").select("y", "x", *"rgb")


def _trc(name: str, gamma: str):
    sql = f"with {EV} select y, x, round(pow(r, {gamma}) + {TIE}, 6) + 0.0 as linear, round(case when r <= 0 then 0.0 else pow(r, 1 / ({gamma})) end + {TIE}, 6) + 0.0 as display from ev"

    @query(f"colour_trc_{name.lower()}", sql)
    def q(spark, sf_dir, name=name):
        df = rasters.events_raster(spark, sf_dir)
        return rounded(df.select("y", "x", colour.decode(F.col("r"), name).alias("linear"), colour.encode(F.col("r"), name).alias("display")), "linear", "display")


for _n, _g in (("AdobeRGB", "563 / 256"), ("ProPhoto", "1.8"), ("Rec2020", "2.4")):
    _trc(_n, _g)


def _primaries(name: str):
    m = colour.TO_SRGB[name]
    sql = f"with {EV} select y, x, " + sql_round(*(f"{m[3 * i]} * r + {m[3 * i + 1]} * g + {m[3 * i + 2]} * b as {c}" for i, c in enumerate("rgb"))) + " from ev"

    @query(f"primaries_{name.lower()}_to_srgb", sql)
    def q(spark, sf_dir, name=name):
        return rounded(colour.apply_matrix(rasters.events_raster(spark, sf_dir), colour.TO_SRGB[name]), *"rgb").select("y", "x", *"rgb")


for _n in ("DisplayP3", "AdobeRGB", "ProPhoto", "Rec2020"):
    _primaries(_n)


@query("luma_mask", f"with {EV} select y, x, {sql_round(f'{ss(str(-4.0), str(-3.0), _EV)} * (1 - {ss(str(1.0), str(2.0), _EV)}) as m')} from ev")
def luma_mask(spark, sf_dir):
    return rounded(rasters.events_raster(spark, sf_dir).select("y", "x", gates.luma_mask(colour.luma(), -3, 1, 1).alias("m")), "m")


@query("smoothstep_gate", f"with {EV} select y, x, {sql_round(ss('0.72', '1.44', 'greatest(r, g, b)') + ' as gate')} from ev")
def smoothstep_gate(spark, sf_dir):
    return rounded(rasters.events_raster(spark, sf_dir).select("y", "x", gates.smoothstep(0.72, 1.44, F.greatest("r", "g", "b")).alias("gate")), "gate")


def _table(values) -> str:
    return "[" + ", ".join(map(str, values)) + "]"


_HUE = """h0 as (select *, greatest(r, g, b) as hi, greatest(r, g, b) - least(r, g, b) as d from ev),
h1 as (select *, hi <= 1e-12 or d <= 1e-12 as flat, case when hi <= 1e-12 or d <= 1e-12 then 0.0 when hi = r then fmod((g - b) / d + 6, 6) when hi = g then (b - r) / d + 2 else (r - g) / d + 4 end as h from h0),
h2 as (select *, cast(floor(h) as integer) % 6 as k, (h - floor(h)) * (h - floor(h)) * (3 - 2 * (h - floor(h))) as t from h1)"""


@query("hue_response", f"""with {EV}, {_HUE} select y, x, {sql_round("case when flat then 0.0 else d / hi end as saturation", *(
    f"case when flat then 1.0 else {_table(v)}[k + 1] + ({_table(v)}[(k + 1) % 6 + 1] - {_table(v)}[k + 1]) * t end as {n}"
    for n, v in (("red", gates.RED_RESPONSE), ("green", gates.GREEN_RESPONSE), ("blue", gates.BLUE_RESPONSE))))} from h2""")
def hue_response(spark, sf_dir):
    h = gates.hue(F.col("r"), F.col("g"), F.col("b"))
    return rounded(rasters.events_raster(spark, sf_dir).select("y", "x", *(h[k].alias(k) for k in ("saturation", "red", "green", "blue"))), "saturation", "red", "green", "blue")


_U = "case when r <= 0.7 then 0.0 when r <= 1 then (r - 0.7) / (1 - 0.7) else 1 + log2(greatest(r, 1.0)) end"


@query("source_response", f"with {EV}, s as (select y, x, {_U} as u from ev) select y, x, {sql_round('u as u', '8 * pow(u, 1 + 1.5 * 0.65) / (7 + pow(u, 1 + 1.5 * 0.65)) as highlight', '8 * (1 - exp(-pow(u, 1 + 1.5 * 0.65) / 8)) as legacy')} from s")
def source_response(spark, sf_dir):
    u = gates.source_exposure(F.col("r"), 0.7)
    df = rasters.events_raster(spark, sf_dir).select("y", "x", u.alias("u"))
    return rounded(df.select("y", "x", "u", gates.highlight_response(F.col("u"), 0.65).alias("highlight"), gates.legacy_response(F.col("u"), 0.65).alias("legacy")), "u", "highlight", "legacy")


@query("exposure_envelope", f"with {EV}, s as (select y, x, log2(greatest({Y709}, 1e-6) / 0.18) as e from ev) select y, x, {sql_round('0.42 + 0.58 * exp(-0.5 * pow((e + 0.5) / 2.0, 2)) as negative', '0.35 + 0.75 * exp(-0.5 * pow((e - 0.3) / 1.4, 2)) as positive')} from s")
def exposure_envelope(spark, sf_dir):
    df = rasters.events_raster(spark, sf_dir).select("y", "x", gates.exposure_envelope(colour.luma()).alias("negative"), gates.exposure_envelope(colour.luma(), "positive").alias("positive"))
    return rounded(df, "negative", "positive")


@query("blend_modes", f"""with {EV} select y, x, {sql_round('r + 0.3 * b as additive', 'r + (case when r <= 0 then 1.0 when r < 1 then 1 - r else 1 / greatest(1.0, r) end) * 0.3 * b as screen')} from ev""")
def blend_modes(spark, sf_dir):
    r, e = F.col("r"), 0.3 * F.col("b")
    return rounded(rasters.events_raster(spark, sf_dir).select("y", "x", (r + e).alias("additive"), (r + gates.screen_gain(r) * e).alias("screen")), "additive", "screen")


@query("density_composite", f"""with {EV}, k as (select *, 0.2 * a * r as er, 0.03 * a * r as eg, 0.01 * a * r as eb, greatest(0.0, {Y709}) as l from ev),
p as (select *, er - greatest(eg, eb) as ex, least(1.0, greatest(0.0, (greatest(g, b) - r) / greatest(1e-8, r, g, b))) as cool,
  least(0.38, greatest(0.12, eg / greatest(er, 1e-8))) as gr, least(0.12, greatest(0.035, eb / greatest(er, 1e-8))) as br from k),
q as (select *, least(0.78, 0.6 * (1 - exp(-6 * greatest(0.0, ex) * (1 + 1.6 * 0.5 * cool))) * (1 - 0.86 * {ss('0.70', '1.05', 'l')})) as m,
  least(l / greatest(1e-8, 0.2126 + 0.7152 * gr + 0.0722 * br), l * 2.4 + 0.05) as tr from p),
s as (select *, r + (tr - r) * m as cr, g + (tr * gr - g) * m as cg, b + (tr * br - b) * m as cb from q),
z as (select *, greatest(0.0, l - (0.2126 * cr + 0.7152 * cg + 0.0722 * cb)) as lift, er <= 1e-12 or ex <= 1e-12 as plain from s)
select y, x, {sql_round(*(f'case when plain then {c} + e{c} else c{c} + lift + e{c} end as o{c}' for c in 'rgb'))} from z""")
def density_composite(spark, sf_dir):
    df = rasters.events_raster(spark, sf_dir)
    halo = [k * F.col("a") * F.col("r") for k in (0.2, 0.03, 0.01)]
    out = gates.density_composite([F.col(c) for c in "rgb"], halo, F.lit(0.6), 0.5)
    return rounded(df.select("y", "x", *(c.alias("o" + n) for c, n in zip(out, "rgb", strict=True))), "or", "og", "ob")


@query("output_knee", f"with {EV} select y, x, {sql_round('case when r <= 0.7 then r else 0.7 + 0.3 * (((r - 0.7) / 0.3) / (1 + (r - 0.7) / 0.3)) end as v')} from ev")
def output_knee(spark, sf_dir):
    return rounded(rasters.events_raster(spark, sf_dir).select("y", "x", colour.output_knee(F.col("r"), 0.6).alias("v")), "v")


@query("quantise_samples", f"with {EV} select y, x, cast(least(greatest(floor(r * 255 + 0.5), 0), 255) as integer) as v8, cast(least(greatest(floor(r * 32768 + 0.5), 0), 32768) as integer) as v16 from ev")
def quantise_samples(spark, sf_dir):
    return rasters.events_raster(spark, sf_dir).select("y", "x", colour.quantise(F.col("r"), 8).alias("v8"), colour.quantise(F.col("r"), 16).alias("v16"))


@query("white_point", f"with {EV} select 'ev' as frame_id, round(greatest(1.0, max(greatest(r, g, b))), 6) as white from ev where a > 0")
def white_point(spark, sf_dir):
    return colour.white_point(rasters.events_raster(spark, sf_dir)).select("frame_id", F.round("white", 6).alias("white"))


_TM = "(case when w <= 1 + 1e-6 or greatest(r, g, b) <= 0 then 1.0 else (1 + greatest(r, g, b) / (w * w)) / (1 + greatest(r, g, b)) end)"


@query("tone_map_sdr", f"with {EV}, w as (select greatest(1.0, max(greatest(r, g, b))) as w from ev where a > 0) select y, x, {sql_round(*(f'{c} * {_TM} as {c}' for c in 'rgb'))} from ev, w")
def tone_map_sdr(spark, sf_dir):
    return rounded(colour.tone_map(rasters.events_raster(spark, sf_dir)).select("y", "x", *"rgb"), *"rgb")


def box_sql(src: str, out: str, columns: list[str], r: int, passes: int = 3) -> str:
    """Box passes as chained SQL views, edges repeated."""
    parts, at = [], src
    for k in range(passes):
        for axis, fixed, size in (("x", "y", "width"), ("y", "x", "height")):
            name = out if k == passes - 1 and axis == "y" else f"{out}_{k}{axis}"
            cols = ", ".join(
                f"(sum({c}) over n + greatest(0, {r} - {axis}) * first_value({c}) over p + greatest(0, {axis} + {r} - ({size} - 1)) * last_value({c}) over p) / {2 * r + 1} as {c}" for c in columns)
            parts.append(f"{name} as (select * exclude ({', '.join(columns)}), {cols} from {at} window n as (partition by {fixed} order by {axis} rows between {r} preceding and {r} following), "
                         f"p as (partition by {fixed} order by {axis} rows between unbounded preceding and unbounded following))")  # fmt: skip
            at = name
    return ", ".join(parts)


@query("box_blur3", f"with {EV}, {box_sql('ev', 'o', ['r', 'g'], 2)} select y, x, {sql_round('r as r', 'g as g')} from o")
def box_blur3(spark, sf_dir):
    return rounded(stencil.box_blur(rasters.events_raster(spark, sf_dir), ["r", "g"], 2.0).select("y", "x", "r", "g"), "r", "g")


_K = stencil.gaussian_kernel(1.0)


def _taps(axis: str, fixed: str) -> str:
    edge = f"over (partition by {fixed} order by {axis} rows between unbounded preceding and unbounded following)"
    one = lambda k, w: f"{w} * " + ("r" if k == 0 else f"coalesce(lag(r, {-k}) over (partition by {fixed} order by {axis}), first_value(r) {edge})" if k < 0 else f"coalesce(lead(r, {k}) over (partition by {fixed} order by {axis}), last_value(r) {edge})")
    return " + ".join(one(k - len(_K) // 2, w) for k, w in enumerate(_K))


@query("gauss_small", f"with {EV}, h as (select y, x, {_taps('x', 'y')} as r from ev), v as (select y, x, {_taps('y', 'x')} as r from h) select y, x, {sql_round('r as r')} from v")
def gauss_small(spark, sf_dir):
    return rounded(stencil.gaussian_blur(rasters.events_raster(spark, sf_dir), ["r"], 1.0).select("y", "x", "r"), "r")


@query("max_filter", f"with {EV}, h as (select y, x, max(r) over (partition by y order by x rows between 3 preceding and 3 following) as r from ev) select y, x, {sql_round('max(r) over (partition by x order by y rows between 3 preceding and 3 following) as r')} from h")
def max_filter(spark, sf_dir):
    return rounded(stencil.max_filter(rasters.events_raster(spark, sf_dir), ["r"], 3).select("y", "x", "r"), "r")


def _scale(s: int):
    @query(f"downsample_{s}", f"with {EV} select cast(y // {s} as integer) as y, cast(x // {s} as integer) as x, round(avg(r) + 2e-10, 6) + 0.0 as r from ev group by 1, 2")
    def down(spark, sf_dir):
        return rounded(stencil.downsample(rasters.events_raster(spark, sf_dir), ["r"], s).select("y", "x", "r"), "r")


for _s in (2, 4, 8):
    _scale(_s)


@query("upsample_bilinear", f"""with {EV}, low as (select y // 4 as cy, x // 4 as cx, avg(r) as v from ev group by 1, 2),
p as (select y, x, (y + 0.5) / 4 - 0.5 as fy, (x + 0.5) / 4 - 0.5 as fx, (height + 3) // 4 - 1 as my, (width + 3) // 4 - 1 as mx from ev),
q as (select *, greatest(0, cast(floor(fy) as bigint)) as y0, greatest(0, cast(floor(fx) as bigint)) as x0 from p),
s as (select *, least(y0 + 1, my) as y1, least(x0 + 1, mx) as x1, fy - y0 as ty, fx - x0 as tx from q)
select s.y, s.x, round((1 - ty) * ((1 - tx) * a.v + tx * b.v) + ty * ((1 - tx) * c.v + tx * d.v) + 2e-10, 6) + 0.0 as r from s
join low a on a.cy = y0 and a.cx = x0 join low b on b.cy = y0 and b.cx = x1 join low c on c.cy = y1 and c.cx = x0 join low d on d.cy = y1 and d.cx = x1""")
def upsample_bilinear(spark, sf_dir):
    df = rasters.events_raster(spark, sf_dir)
    return rounded(stencil.upsample(stencil.downsample(df, ["r"], 4), df, ["r"], 4).select("y", "x", "r"), "r")


_CELLS = f"""with {EV}, c as (select k.cy, m.cx, floor(k.cy * height / 7.0) as ya, ceil((k.cy + 1) * height / 7.0) as yb, floor(m.cx * width / 33.0) as xa, ceil((m.cx + 1) * width / 33.0) as xb
from (select range as cy from range(7)) k, (select range as cx from range(33)) m, (select distinct width, height from ev)),
j as (select cast(cy as integer) as cy, cast(cx as integer) as cx, r, g from ev join c on y >= ya and y < yb and x >= xa and x < xb)"""


@query("preview_box_cells", f"{_CELLS} select cy as y, cx as x, round(avg(r) + 2e-10, 6) + 0.0 as r from j group by cy, cx")
def preview_box_cells(spark, sf_dir):
    return rounded(stencil.preview_cells(rasters.events_raster(spark, sf_dir), ["r"], 33, 7).select("y", "x", "r"), "r")


@query("weighted_downsample", f"{_CELLS} select cy as y, cx as x, round(case when sum(greatest(0, g)) <= 1e-12 then 0.0 else sum(r * greatest(0, g)) / sum(greatest(0, g)) end + 2e-10, 6) + 0.0 as r from j group by cy, cx")
def weighted_downsample(spark, sf_dir):
    return rounded(stencil.preview_cells(rasters.events_raster(spark, sf_dir), ["r"], 33, 7, weight="g").select("y", "x", "r"), "r")


@query("crop_inspect", f"with {EV} select y, x, round(r + 2e-10, 6) + 0.0 as r from ev where x >= 20 and x < 60 and y >= 2 and y < 9")
def crop_inspect(spark, sf_dir):
    return rounded(stencil.crop(rasters.events_raster(spark, sf_dir), 20, 2, 60, 9).select("y", "x", "r"), "r")


@query("frame_difference", f"with {EV}, {box_sql('ev', 'o', ['r', 'g', 'b'], 1, 1)} select 'ev' as frame_id, round(sqrt(sum((ev.r - o.r) ** 2 + (ev.g - o.g) ** 2 + (ev.b - o.b) ** 2) / (3 * count(*))) + 2e-10, 6) as rms, round(max(greatest(abs(ev.r - o.r), abs(ev.g - o.g), abs(ev.b - o.b))) + 2e-10, 6) as largest from ev join o using (y, x)")
def frame_difference(spark, sf_dir):
    df = rasters.events_raster(spark, sf_dir)
    return rounded(stencil.difference(df, stencil.box_blur(df, list("rgb"), 1.0, 1)), "rms", "largest")


@query("band_assign", f"with {EV}, n as (select y, x, height, unnest(range(0, (height + 15) // 16)) as band from ev) select cast(band as integer) as band, count(*) as pixels, sum(case when y // 16 = band then 1 else 0 end)::bigint as core from n where y >= band * 16 - 5 and y < (band + 1) * 16 + 5 group by band")
def band_assign(spark, sf_dir):
    return stencil.bands(rasters.events_raster(spark, sf_dir), 16, 5).groupBy("band").agg(F.count("*").alias("pixels"), F.sum(F.col("core").cast("long")).alias("core"))


def _fmix_sql(h: str) -> list[str]:
    m = 4294967295
    return [f"((xor({h}, {h} >> 16) * {0x85EBCA6B}::hugeint) & {m})::bigint", "((xor({0}, {0} >> 13) * " + f"{0xC2B2AE35}::hugeint) & {m})::bigint", "xor({0}, {0} >> 16)"]


def _hash_views() -> str:
    """hash32(seed 0x12345678, node, x, y, 2, 1, 0) as chained views."""
    first = rng.fmix32(rng.fmix32(0x12345678 ^ rng.GOLDEN) ^ rng.fnv1a("grain-main"))
    parts, at = [], "(select y, x, " + f"{first}::bigint as h from ev)"
    for k, w in enumerate(("x", "y", "2", "1", "0")):
        a, b, c = _fmix_sql(f"xor(h, {w}::bigint)")
        parts += [f"a{k} as (select y, x, {a} as h from {at})", f"b{k} as (select y, x, {b.format('h')} as h from a{k})", f"c{k} as (select y, x, {c.format('h')} as h from b{k})"]
        at = f"c{k}"
    return ", ".join(parts)


@query("grain_hash", f"with {EV}, {_hash_views()} select y, x, h from c4")
def grain_hash(spark, sf_dir):
    df = rasters.events_raster(spark, sf_dir).withColumn("h", F.lit(rng.fmix32(rng.fmix32(0x12345678 ^ rng.GOLDEN) ^ rng.fnv1a("grain-main"))).cast("long"))
    for w in (F.col("x"), F.col("y"), F.lit(2), F.lit(1), F.lit(0)):
        df = df.withColumn("h", rng.fmix32_column(F.col("h").bitwiseXOR(rng.u32(w))))
    return df.select("y", "x", "h")


_B = f"""with {EV}, f as (select *, (r + 2 * g + b) * 0.25 as l, (-r + 2 * g - b) * 0.25 as c, (r + 2 * g + b) * 0.25 as lb, (-r + 2 * g - b) * 0.25 as cb, (r - b) * 0.5 as co from ev),
{box_sql('f', 'o', ['lb', 'cb'], 1)}, m as (select *, 0.65 * {ss('0.01', '0.08', 'abs(l - lb)')} * {ss('0.08', '0.2', 'abs(c - cb)')} * a as m from o),
k as (select *, c + (cb - c) * m as k from m)"""


@query("defringe_fast", f"{_B} select y, x, {sql_round('l - k + co as r', 'l + k as g', 'l - k - co as b')} from k")
def defringe_fast(spark, sf_dir):
    r, g, b = (F.col(c) for c in "rgb")
    l, c = (r + 2 * g + b) * 0.25, (-r + 2 * g - b) * 0.25
    df = rasters.events_raster(spark, sf_dir).select("*", l.alias("l"), c.alias("c"), l.alias("lb"), c.alias("cb"), ((r - b) * 0.5).alias("co"))
    df = stencil.box_blur(df, ["lb", "cb"], 1.5)
    mix = 0.65 * gates.smoothstep(0.01, 0.08, F.abs(F.col("l") - F.col("lb"))) * gates.smoothstep(0.08, 0.2, F.abs(F.col("c") - F.col("cb"))) * F.col("a")
    df = df.withColumn("k", F.col("c") + (F.col("cb") - F.col("c")) * mix)
    return rounded(df.select("y", "x", (F.col("l") - F.col("k") + F.col("co")).alias("r"), (F.col("l") + F.col("k")).alias("g"), (F.col("l") - F.col("k") - F.col("co")).alias("b")), *"rgb")


_GATE = ss("0.72", "1.44", "greatest(r, g, b)")


@query("highlight_source", f"with {EV}, s as (select y, x, {', '.join(f'greatest(0.0, {c}) * {_GATE} * a as {c}' for c in 'rgb')} from ev) select y, x, {sql_round(*(f'greatest(0.0, {Y709} + ({c} - {Y709}) * 0.85) as {c}' for c in 'rgb'))} from s")
def highlight_source(spark, sf_dir):
    gate = gates.smoothstep(0.72, 1.44, F.greatest("r", "g", "b"))
    df = rasters.events_raster(spark, sf_dir).withColumns({c: F.greatest(F.lit(0.0), F.col(c)) * gate * F.col("a") for c in "rgb"})
    y = colour.luma()
    return rounded(colour.mapped(df, lambda v: F.greatest(F.lit(0.0), y + (v - y) * 0.85)).select("y", "x", *"rgb"), *"rgb")


@query("resolution_weights", f"with {EV}, s as (select y, x, log2(greatest(1e-6, {Y709}) / 0.18) as e from ev) select y, x, {sql_round('least(1.5, greatest(0.0, 1 + 0.25 * (1 - ' + ss('-6', '-2', 'e') + ') + 0.15 * ' + ss('2', '6', 'e') + ')) as w')} from s")
def resolution_weights(spark, sf_dir):
    e = F.log2(F.greatest(F.lit(1e-6), colour.luma()) / 0.18)
    w = 1 + 0.25 * (1 - gates.smoothstep(-6, -2, e)) + 0.15 * gates.smoothstep(2, 6, e)
    return rounded(rasters.events_raster(spark, sf_dir).select("y", "x", F.least(F.lit(1.5), F.greatest(F.lit(0.0), w)).alias("w")), "w")


def _size(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    df = rasters.events_raster(spark, sf_dir)
    return df, df.select("height").first()["height"]


def _graph(kinds: dict[str, dict], quality: str):
    def q(spark, sf_dir):
        df, height = _size(spark, sf_dir)
        nodes = [graph.validate_node({"id": f"{k}-main", "type": k, "params": p}) for k, p in kinds.items()]
        nodes.sort(key=lambda n: n.effect.stage)
        out = R.render(df, graph.plan(nodes, 100, height, quality=quality, band_pixels=1_000_000))
        return rounded(out.select("frame_id", "y", "x", *"rgb", "a"), *"rgb")

    return q


_HALATION = graph.EFFECTS["halation"].presets
for _name, _kinds, _quality in (
    ("defringe_quality", {"defringe": {}}, "quality"),
    ("halation_fast", {"halation": _HALATION["standard"]}, "fast"),
    ("halation_quality", {"halation": {**_HALATION["tungsten-800"], "diffusionMode": "quality"}}, "quality"),
    ("bloom_fast", {"bloom": {}}, "fast"),
    ("bloom_protected", {"bloom": {}, "highlightProtection": {}}, "quality"),
    ("film_resolution", {"filmResolution": {}}, "quality"),
    ("grain_analogue", {"grain": {"seedMode": "fixed"}}, "quality"),
    ("grain_fast", {"grain": {"seedMode": "fixed", "mode": "fast"}}, "fast"),
    ("full_graph_fast", {"defringe": {}, "halation": _HALATION["standard"], "bloom": {}, "highlightProtection": {}, "filmResolution": {}, "grain": {"seedMode": "fixed"}}, "fast"),
    ("full_graph_quality", {"defringe": {}, "halation": _HALATION["standard"], "bloom": {}, "highlightProtection": {}, "filmResolution": {}, "grain": {"seedMode": "fixed"}}, "quality"),
):
    query(_name)(_graph(_kinds, _quality))


_M = 4294967295
_NOISE = f"(select *, xor(((x + {0x51ED270B}) & {_M})::hugeint * {0x85EBCA6B} & {_M}, ((y + {0x68BC21EB}) & {_M})::hugeint * {0xC2B2AE35} & {_M})::bigint as v from p)"
_TILE = f"""p as (select cast(range // 64 as bigint) as y, cast(range % 64 as bigint) as x from range(4096)), n0 as (select y, x, (xor(v, v >> 16)::hugeint * {0x7FEB352D} & {_M})::bigint as v from {_NOISE}), n as (select y, x, xor(v, v >> 15) / 4294967296.0 as v from n0),
s as (select n.y, n.x, n.v - (select sum(m.v) from n m where (m.y - n.y + 65) % 64 <= 2 and (m.x - n.x + 65) % 64 <= 2 and not (m.y = n.y and m.x = n.x)) / 8 as score from n), tile as (select y, x, (row_number() over (order by score, y, x) - 0.5) / 4096 - 0.5 as noise from s)"""


def _dither_sql(seed: int = 0x46534C4D) -> str:
    joins, out = [], []
    for k, c in enumerate("rgb"):
        sx, sy = (seed ^ (k + 1) * 0x9E3779B1) & 63, (seed >> 8 ^ (k + 3) * 0x85EBCA6B) & 63
        tx, ty = (("ev.x", "ev.y"), ("ev.y", "-ev.x"), ("ev.x + ev.y", "ev.y - ev.x"))[k]
        joins.append(f"join tile t{c} on t{c}.x = (({tx} + {sx}) % 64 + 64) % 64 and t{c}.y = (({ty} + {sy}) % 64 + 64) % 64")
        out.append(f"cast(least(greatest(floor(ev.{c} * 255 + t{c}.noise + 0.5), 0), 255) as integer) as {c}")
    return f"with {EV}, {_TILE} select 'ev' as frame_id, ev.y, ev.x, {', '.join(out)}, cast(floor(a * 255 + 0.5) as integer) as a from ev {' '.join(joins)}"


@query("dithered_samples", _dither_sql())
def dithered_samples(spark, sf_dir):
    return rasters.quantised(rasters.events_raster(spark, sf_dir).select("frame_id", "y", "x", *"rgb", "a"), 8)


@query("png_encode")
def png_encode(spark, sf_dir):
    return rasters.png_frames(rasters.quantised(rasters.events_raster(spark, sf_dir).select("frame_id", "y", "x", *"rgb", "a"), 8, dither=False))


from rasterflow import registry_more  # noqa: E402, F401
