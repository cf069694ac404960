"""More registered queries: whole effects, profiles, previews, generators and documents, each with the same computation as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterflow.functions import colour, gates, profiles, rng
from rasterflow.operators import kernels, preview, stencil
from rasterflow.operators import render as R
from rasterflow.operators.effects import EFFECTS
from rasterflow.plans import graph
from rasterflow.registry import DEC, ENC, EV, Y709, _fmix_sql, box_sql, query, rounded, sql_round, ss
from rasterflow.sources import documents, rasters

ev = rasters.events_raster


@query("luma_by_profile", f"with {EV} select y, x, " + sql_round(*(f"{w[0]} * r + {w[1]} * g + {w[2]} * b as l_{k.lower()}" for k in ("AdobeRGB", "Rec2020", "ProPhoto") for w in [profiles.luma_weights(k)])) + " from ev")
def luma_by_profile(spark, sf_dir):
    names = {k: f"l_{k.lower()}" for k in ("AdobeRGB", "Rec2020", "ProPhoto")}
    return rounded(ev(spark, sf_dir).select("y", "x", *[colour.luma(weights=profiles.luma_weights(k)).alias(n) for k, n in names.items()]), *names.values())


def _back(name: str):
    m = colour.FROM_SRGB[name]

    @query(f"primaries_srgb_to_{name.lower()}", f"with {EV} select y, x, " + sql_round(*(f"{m[3 * i]} * r + {m[3 * i + 1]} * g + {m[3 * i + 2]} * b as {c}" for i, c in enumerate("rgb"))) + " from ev")
    def q(spark, sf_dir):
        return rounded(colour.apply_matrix(ev(spark, sf_dir), m), *"rgb").select("y", "x", *"rgb")


for _n in ("DisplayP3", "AdobeRGB", "ProPhoto", "Rec2020"):
    _back(_n)


@query("bt2020_camera_curve", f"with {EV} select y, x, " + sql_round(
    "case when r <= 0 then 0.0 when r < 0.08145 then r / 4.5 else pow((r + 0.0993) / 1.0993, 1 / 0.45) end as linear",
    "case when r <= 0 then 0.0 when r < 0.0181 then r * 4.5 else 1.0993 * pow(r, 0.45) - 0.0993 end as display") + " from ev")
def bt2020_camera_curve(spark, sf_dir):
    return rounded(ev(spark, sf_dir).select("y", "x", colour.decode_bt2020(F.col("r")).alias("linear"), colour.encode_bt2020(F.col("r")).alias("display")), "linear", "display")


@query("linear_profile", f"with {EV} select y, x, {sql_round('r as decoded', 'g as encoded')} from ev")
def linear_profile(spark, sf_dir):
    return rounded(ev(spark, sf_dir).select("y", "x", colour.decode(F.col("r"), "linear").alias("decoded"), colour.encode(F.col("g"), "linear").alias("encoded")), "decoded", "encoded")


#: Names as hosts report them, dealt over events.
NAMES = ("sRGB IEC61966-2.1", "Adobe RGB (1998)", "AdobeRGB1998", "Display P3", "display-p3", "P3", "ProPhoto RGB (Linear RGB Profile)", "Rec. 2020 (Linear)", "ITU-R BT.2020", "ITU 2020", "Dot Gain 20%", "", "linear", "rec2020 (linear profile) ")
_NAMED = "n as (select event_id, [" + ", ".join(f"'{n}'" for n in NAMES) + f"][cast(event_id % {len(NAMES)} as integer) + 1] as name from events)"


def _named(spark, sf_dir):
    at = F.pmod(F.col("event_id").cast("long"), F.lit(len(NAMES))).cast("int") + 1
    return rasters.table(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*map(F.lit, NAMES)), at).alias("name"))


_BASE = "case " + " ".join("when " + " or ".join([f"contains(lower(name), '{p}')" for p in parts] + ["lower(name) = 'p3'"] * (key == "DisplayP3")) + f" then '{key}'" for key, parts in profiles.PARTS) + " end"


@query("profile_resolution", f"with {_NAMED}, b as (select *, {_BASE} as known from n) select event_id, name, case when contains(lower(name), 'linear') then 'linear' else coalesce(known, 'sRGB') end as transfer, coalesce(known, 'sRGB') as base, known is null as assumed from b")
def profile_resolution(spark, sf_dir):
    return _named(spark, sf_dir).select("event_id", "name", *[c.alias(n) for n, c in profiles.resolve_column(F.col("name")).items()])


@query("profile_written_name", f"with {_NAMED} select event_id, trim(regexp_replace(name, '\\s*\\((?:linear\\s+rgb\\s+profile|linear\\s+profile)\\)\\s*$', '', 'i')) as written from n")
def profile_written_name(spark, sf_dir):
    return _named(spark, sf_dir).select("event_id", profiles.written_name(F.col("name")).alias("written"))


@query("threshold_curves", """with v as (select range / 8.0 - 2 as v from range(0, 64))
select v, round(0.18 * pow(2, v), 6) as stops, case when v >= 1 then null else round(case when v > 0.9 then 0.9 + (v - 0.9) * 0.1 / greatest(1e-9, 1 - v) else v end, 6) end as source,
case when v >= 4 then null else round(0.18 * pow(2, case when v > 3 then 3 + (v - 3) / greatest(1e-9, 4 - v) else v end), 6) end as source_stops, round(v / 1000 * sqrt(6000 * 6000 + 4000 * 4000), 6) as sigma from v""")
def threshold_curves(spark, sf_dir):
    cut = lambda x: None if x is None else round(x, 6)
    rows = [(v, cut(gates.threshold_linear(v, "stops")), cut(gates.halation_threshold(v)), cut(gates.halation_threshold(v, "stops")), cut(gates.sigma_pixels(v, "diagonal", 6000, 4000))) for v in (k / 8 - 2 for k in range(64))]
    return spark.createDataFrame(rows, "v double, stops double, source double, source_stops double, sigma double")


_M = f"({ss('-4.0', '-3.0', 'e')} * (1 - {ss('1.0', '2.0', 'e')}))"


@query("effect_masks", f"with {EV}, m0 as (select *, log2(greatest(pow(2.0, -24), {Y709}) / 0.18) as e from ev), m as (select *, 1 - {_M} as m from m0) select y, x, {sql_round('r + (r * 0.5 + 0.1 - r) * m as lerped', 'r + 0.3 * g * m as added')} from m")
def effect_masks(spark, sf_dir):
    m = gates.luma_mask(colour.luma(), -3, 1, 1, invert=True)
    r = F.col("r")
    return rounded(ev(spark, sf_dir).select("y", "x", gates.masked(r, r * 0.5 + 0.1, m).alias("lerped"), (r + gates.masked_contribution(0.3 * F.col("g"), m)).alias("added")), "lerped", "added")


@query("preview_sizes", """with s as (select range + 1 as n from range(0, 200)), t as (select n * 37 as width, n * 23 as height from s)
select cast(width as integer) as width, cast(height as integer) as height, round(case when greatest(width, height) > 1024 then 1024.0 / greatest(width, height) else 1.0 end, 9) as scale,
cast(greatest(3, least(width - least(width - 3, 640), floor(width * 0.25 - least(width - 3, 640) / 2.0 + 0.5))) as integer) as "left", cast(least(width - 3, 640) as integer) as visible from t""")
def preview_sizes(spark, sf_dir):
    rows = []
    for n in range(1, 201):
        w, h = n * 37, n * 23
        v = preview.visible_bounds({"left": 2.5, "top": 0, "right": w, "bottom": h}, {"x": w * 0.25}, {"width": 640, "height": 480})
        rows.append((w, h, round(preview.preview_scale(w, h), 9), v["left"], v["width"]))
    return spark.createDataFrame(rows, "width int, height int, scale double, left int, visible int")


_CELLS = """k as (select k.cy, m.cx, floor(k.cy * height / 7.0) as ya, ceil((k.cy + 1) * height / 7.0) as yb, floor(m.cx * width / 33.0) as xa, ceil((m.cx + 1) * width / 33.0) as xb
from (select range as cy from range(7)) k, (select range as cx from range(33)) m, (select distinct width, height from ev))"""


@query("reduced_fields", f"""with {EV}, {_CELLS}, j as (select cast(cy as integer) as cy, cast(cx as integer) as cx, ev.* from ev join k on y >= ya and y < yb and x >= xa and x < xb)
select cy as y, cx as x, {sql_round('avg(g - 0.2) as w', 'avg(a) as gate', f'avg({Y709}) as luma', 'avg(r) as source_r', 'avg(g) as source_g', 'avg(b) as source_b',
'case when sum(g - 0.2) > 1e-12 then sum(r * greatest(0.0, g - 0.2)) / sum(g - 0.2) else 0.0 end as u', 'greatest(0.0, max(b)) as k')} from j group by cy, cx""")
def reduced_fields(spark, sf_dir):
    f = ev(spark, sf_dir).select("frame_id", "y", "x", "width", "height", (F.col("g") - 0.2).alias("w"), F.col("a").alias("gate"), colour.luma().alias("luma"), F.col("r").alias("source_r"), F.col("g").alias("source_g"), F.col("b").alias("source_b"), F.col("r").alias("u"), F.col("b").alias("k"))
    return rounded(preview.reduced_fields(f, 33, 7).drop("frame_id"), *preview.ENERGY, "u", "k")


def _taps(kernel, column: str, axis: str, fixed: str) -> str:
    edge = f"over (partition by {fixed} order by {axis} rows between unbounded preceding and unbounded following)"
    line = f"over (partition by {fixed} order by {axis})"
    mid = len(kernel) // 2
    one = lambda k: column if k == 0 else f"coalesce(lag({column}, {-k}) {line}, first_value({column}) {edge})" if k < 0 else f"coalesce(lead({column}, {k}) {line}, last_value({column}) {edge})"
    return " + ".join(f"{w} * {one(k - mid)}" for k, w in enumerate(kernel))


_K24 = stencil.gaussian_kernel(2.4)


@query("placeholder_blur", f"""with {EV}, s as (select least(1.0, 40.0 / greatest(width, height)) as s, width, height from ev limit 1), z as (select greatest(1, floor(width * s + 0.5)) as ow, greatest(1, floor(height * s + 0.5)) as oh, width, height from s),
k as (select cast(cy.range as integer) as cy, cast(cx.range as integer) as cx, floor(cy.range * (height / oh)) as ya, ceil((cy.range + 1) * (height / oh)) as yb, floor(cx.range * (width / ow)) as xa, ceil((cx.range + 1) * (width / ow)) as xb
  from z, range(0, 40) cy, range(0, 40) cx where cy.range < oh and cx.range < ow),
c as (select cy as y, cx as x, avg(r) as r, avg(a) as a from ev join k on y >= ya and y < yb and x >= xa and x < xb group by cy, cx),
h as (select y, x, a, {_taps(_K24, 'r', 'x', 'y')} as r from c), v as (select y, x, a, {_taps(_K24, 'r', 'y', 'x')} as r from h) select y, x, {sql_round('r as r', 'a as a')} from v""")
def placeholder_blur(spark, sf_dir):
    df = ev(spark, sf_dir)
    size = df.select("width", "height").first()
    return rounded(preview.placeholder(df, size["width"], size["height"]).select("y", "x", "r", "a"), "r", "a")


@query("gain_transfer", f"with {EV} select y, x, {sql_round('case when g = 0 then r else r + 0.6 * (r * ((g * 1.1 + 0.01) / g) - r) end as gained', 'b + ((g * 1.1 + 0.01) - g) as moved')} from ev")
def gain_transfer(spark, sf_dir):
    df = ev(spark, sf_dir)
    same = lambda e: df.select("frame_id", "y", "x", *[e.alias(c) for c in "rgb"])
    before, after = same(F.col("g")), same(F.col("g") * 1.1 + 0.01)
    gained = preview.transfer_gain(df, before, after, 0.6).select("y", "x", F.col("r").alias("gained"))
    moved = preview.transfer_delta(df, before, after).select("y", "x", F.col("b").alias("moved"))
    return rounded(gained.join(moved, ["y", "x"]), "gained", "moved")


_P = colour.TO_SRGB["Rec2020"]
_PM = ", ".join(f"{_P[3 * i]} * r + {_P[3 * i + 1]} * g + {_P[3 * i + 2]} * b as {c}" for i, c in enumerate("rgb"))
_TM = "(case when w <= 1 + 1e-6 or greatest(r, g, b) <= 0 then 1.0 else (1 + greatest(r, g, b) / (w * w)) / (1 + greatest(r, g, b)) end)"


@query("panel_preview", f"""with {EV}, l as (select y, x, a, {_PM} from ev), w as (select greatest(1.0, max(greatest(r, g, b))) as w from l where a > 0), t as (select y, x, {', '.join(f'{c} * {_TM} as {c}' for c in 'rgb')} from l, w)
select y, x, {sql_round(*(ENC.format(c) + ' as ' + c for c in 'rgb'))} from t""")
def panel_preview(spark, sf_dir):
    return rounded(preview.panel_preview(ev(spark, sf_dir), profiles.resolve("Rec. 2020", depth=32), 32).select("y", "x", *"rgb"), *"rgb")


@query("slider_curves", f"with {EV}, t as (select y, x, least(1.0, greatest(0.0, r)) as t from ev) select y, x, {sql_round('pow(t, 2.2) as fine_low', '1 - pow(1 - t, 2.2) as fine_high', '1 - pow(1 - t, 1 / 2.2) as place')} from t")
def slider_curves(spark, sf_dir):
    r = F.col("r")
    return rounded(ev(spark, sf_dir).select("y", "x", preview.slider_unit(r, "fine-min").alias("fine_low"), preview.slider_unit(r, "fine-max").alias("fine_high"), preview.slider_position(r, "fine-max").alias("place")), "fine_low", "fine_high", "place")


@query("dual_run_report", f"""with {EV}, {box_sql('ev', 'o', ['r', 'g', 'b'], 1, 1)}, d as (select y, x, abs(ev.r - o.r) as dr, abs(ev.g - o.g) as dg, abs(ev.b - o.b) as db from ev join o using (y, x)),
f as (select y, x, case when dr > 0.4 then 'R' when dg > 0.4 then 'G' else 'B' end as channel from d where greatest(dr, dg, db) > 0.4 order by y, x limit 1),
s as (select round(sqrt(sum(dr * dr + dg * dg + db * db) / (3 * count(*))) + 2e-10, 6) as rms, round(max(greatest(dr, dg, db)) + 2e-10, 6) as largest from d)
select 'ev' as frame_id, s.rms, s.largest, f.y, f.x, f.channel from s left join f on true""")
def dual_run_report(spark, sf_dir):
    df = ev(spark, sf_dir)
    return rounded(stencil.difference(df, stencil.box_blur(df, list("rgb"), 1.0, 1), 0.4), "rms", "largest")


_FNV = "list_reduce(list_prepend(2166136261::bigint, {0}), lambda h, u: ((xor(h, u) * 16777619) & 4294967295)::bigint)"
_UTF16 = "flatten(list_transform(list_filter(string_split({0}, ''), lambda c: c <> ''), lambda c: case when unicode(c) > 65535 then [(55296 + ((unicode(c) - 65536) >> 10))::bigint, (56320 + ((unicode(c) - 65536) & 1023))::bigint] else [unicode(c)::bigint] end))"
_UTF8 = "list_transform(range(1, octet_length(encode({0})) * 2, 2), lambda k: ('0x' || substr(hex(encode({0})), k, 2))::bigint)"


@query("text_hashes", "with t as (select n_nationkey, n_name || chr(233) || chr(128512) as s from nation) select n_nationkey, " + _FNV.format(_UTF8.format("s")) + " as bytes_hash, " + _FNV.format(_UTF16.format("s")) + " as units_hash from t")
def text_hashes(spark, sf_dir):
    s = F.concat("n_name", F.lit("é😀"))
    return rasters.table(spark, sf_dir, "nation").select("n_nationkey", documents.fnv_utf8(s).alias("bytes_hash"), documents.fnv_utf16(s).alias("units_hash"))


_PATH = "case when s_suppkey % 5 = 0 then '' else 'C:\\Work\\' || s_name || '.PSD' end"
_VIRTUAL = "'unsaved://' || s_suppkey || '/' || lower(s_name)"
_DOCS = f"p as (select s_suppkey, s_name as name, {_PATH} = '' as unsaved, case when {_PATH} = '' then {_VIRTUAL} else lower(replace({_PATH}, chr(92), '/')) end as s from supplier), d as (select s_suppkey, name, unsaved, lpad(lower(to_hex({_FNV.format(_UTF16.format('s'))})), 8, '0') as path_hash from p), fp as (select *, 'doc-' || path_hash || '-' || regexp_replace(name, '[^A-Za-z0-9_.\\-]', '_', 'g') || '.film.json' as key from d)"


def _documents(spark, sf_dir):
    path = F.when(F.col("s_suppkey") % 5 == 0, "").otherwise(F.concat(F.lit("C:\\Work\\"), "s_name", F.lit(".PSD")))
    return documents.fingerprints(rasters.table(spark, sf_dir, "supplier").select("s_suppkey", path.alias("path"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("id")))


@query("document_fingerprints", f"with {_DOCS} select s_suppkey, path_hash, unsaved, key from fp")
def document_fingerprints(spark, sf_dir):
    return _documents(spark, sf_dir).select("s_suppkey", "path_hash", "unsaved", "key")


@query("document_import", f"with {_DOCS} select s_suppkey, key, case when s_suppkey % 3 <> 0 then 'written' when s_suppkey % 2 = 0 then 'overwritten' else 'preserved' end as action from fp")
def document_import(spark, sf_dir):
    d = _documents(spark, sf_dir).select("s_suppkey", "key")
    return documents.import_plan(d, d.where("s_suppkey % 3 = 0"), d.where("s_suppkey % 2 = 0")).select("s_suppkey", "key", "action")


@query("layer_bindings", """with l as (select p_size as document, p_partkey as layer, p_type as name from part), b as (select p_size as document, case when p_partkey % 3 = 0 then p_partkey + 100000 else p_partkey end as id, case when p_partkey % 5 = 0 then null else p_type end as name, p_partkey from part),
c as (select document, name, count(*) as n, min(layer) as layer from l group by 1, 2)
select b.p_partkey, case when l.layer is not null and (b.name is null or l.name = b.name) then l.layer when c.n = 1 then c.layer end as layer from b left join l on l.document = b.document and l.layer = b.id left join c on c.document = b.document and c.name = b.name""")
def layer_bindings(spark, sf_dir):
    part = rasters.table(spark, sf_dir, "part")
    layers = part.select(F.col("p_size").alias("document"), F.col("p_partkey").alias("layer"), F.col("p_type").alias("name"))
    third = F.col("p_partkey") % 3 == 0
    asked = part.select("p_partkey", F.col("p_size").alias("document"), F.when(third, F.col("p_partkey") + 100000).otherwise(F.col("p_partkey")).alias("id"), F.when(F.col("p_partkey") % 5 == 0, None).otherwise(F.col("p_type")).alias("name"))
    return documents.resolve_bindings(layers, asked).select("p_partkey", "layer")


def _mix(state: str, words: list[str], table: str, name: str) -> tuple[str, str]:
    """Views that carry h through fmix32 with each word, and the last one's name."""
    parts, at = [], f"(select *, {state}::bigint as h from {table})"
    for k, w in enumerate(words):
        a, b, c = _fmix_sql(f"xor(h, {w}::bigint)")
        parts += [f"{name}a{k} as (select * replace ({a} as h) from {at})", f"{name}b{k} as (select * replace ({b.format('h')} as h) from {name}a{k})", f"{name}c{k} as (select * replace ({c.format('h')} as h) from {name}b{k})"]
        at = f"{name}c{k}"
    return ", ".join(parts), at


_SEED = _mix(f"xor(u & 4294967295, {rng.fnv1a('doc') ^ rng.fnv1a('grain-main') ^ rng.GOLDEN})", ["0"], "ev0", "s")


@query("derived_seeds", f"with {EV}, {_SEED[0]} select i as event_id, h as seed from {_SEED[1]}")
def derived_seeds(spark, sf_dir):
    events = rasters.table(spark, sf_dir, "events")
    return events.select(F.col("event_id").cast("long").alias("event_id"), rng.derive_seed_column(F.col("user_id").cast("long"), "doc", "grain-main").alias("seed"))


_START = rng.fmix32(rng.fmix32(0x12345678 ^ rng.GOLDEN) ^ rng.fnv1a("grain-main"))
_G5 = _mix(str(_START), ["x", "y", "2", "1"], "ev", "g")
_DRAWS = [_mix("h0", [str(k)], "(select y, x, h as h0 from base)", f"d{k}_") for k in range(12)]


def _sum12() -> str:
    t = "cast(0 as float)"
    for k in range(12):
        t = f"cast(cast({t} as double) + {_DRAWS[k][1]}.h / 4294967296.0 as float)"
    return t


@query("gaussian_field", f"with {EV}, {_G5[0]}, base as (select y, x, h from {_G5[1]}), " + ", ".join(d[0] for d in _DRAWS)
       + f" select y, x, round(cast(cast(cast({_sum12()} as double) - 6 as float) as double), 6) + 0.0 as z from {_DRAWS[0][1]} " + " ".join(f"join {d[1]} using (y, x)" for d in _DRAWS[1:]))
def gaussian_field(spark, sf_dir):
    return ev(spark, sf_dir).select("y", "x", (F.round(rng.gaussian_column(0x12345678, "grain-main", F.col("x"), F.col("y"), 2, 1).cast("double"), 6) + 0.0).alias("z"))


@query("document_samples", f"with {EV}, q as (select y, x, cast(least(greatest(floor(r * 32768 + 0.5), 0), 32768) as integer) as raw, cast(floor(a * 32768 + 0.5) as integer) as alpha from ev) select y, x, raw, round(raw / 32768.0 + 2e-10, 6) + 0.0 as r, round(alpha / 32768.0 + 2e-10, 6) + 0.0 as a from q")
def document_samples(spark, sf_dir):
    stored = rasters.quantised(ev(spark, sf_dir).select("frame_id", "y", "x", *"rgb", "a"), 16, dither=False)
    raw, read = rasters.read_samples(stored, 16, raw=True), rasters.read_samples(stored, 16)
    return rounded(raw.select("y", "x", F.col("r").alias("raw")).join(read.select("y", "x", "r", "a"), ["y", "x"]), "r", "a")


@query("sample_frames", """with p as (select cast(range // 256 as integer) as y, cast(range % 256 as integer) as x from range(65536)),
d as (select *, sqrt((x - 170) ** 2 + (y - 80) ** 2) as d, ((x - 128) / 42.0) ** 2 + ((y - 100) / 52.0) ** 2 as head, ((x - 128) / 78.0) ** 2 + ((y - 190) / 34.0) ** 2 as body, greatest(0.0, 1 - sqrt((x - 30) ** 2 + (y - 90) ** 2) / 160) as side,
  sqrt((x - 70) ** 2 + (y - 130) ** 2) as d0, sqrt((x - 150) ** 2 + (y - 90) ** 2) as d1, sqrt((x - 200) ** 2 + (y - 170) ** 2) as d2 from p),
f as (select 'sun' as frame_id, y, x, case when d < 26 then 255 when d < 40 then greatest(90 + y / 256.0 * 60, 255 * (1 - (d - 26) / 14) + (90 + y / 256.0 * 60) * (d - 26) / 14) else 90 + y / 256.0 * 60 end as r from d
union all select 'window', y, x, case when x between 100 and 156 and y between 70 and 140 then 240 when x between 96 and 160 and y between 66 and 144 then 150 else 22 end from d
union all select 'portrait', y, x, case when head <= 1 then least(255.0, 190 + side * 40) when body <= 1 then 60 else 14 end from d
union all select 'night', y, x, case when d2 < 4 then 0.9 * 255 when d2 < 22 then greatest(r1, 0.9 * 255 * (1 - d2 / 22) * 0.9) else r1 end from (select *, case when d1 < 4 then 0.95 * 255 when d1 < 22 then greatest(r0, 0.95 * 255 * (1 - d1 / 22) * 0.9) else r0 end as r1
  from (select *, case when d0 < 4 then 255.0 when d0 < 22 then greatest(8 + y * 0.04, 255 * (1 - d0 / 22) * 0.9) else 8 + y * 0.04 end as r0 from d)))
select frame_id, y, x, round(r / 255 + 2e-10, 6) + 0.0 as r from f""")
def sample_frames(spark, sf_dir):
    return rounded(rasters.sample_frames(spark).select("frame_id", "y", "x", "r"), "r")


def _crop(kinds: dict[str, dict], frame: tuple[int, int], fmt: dict | None = None, quality: str = "fast"):
    """A graph over the event raster as a crop of a larger frame."""

    def q(spark, sf_dir):
        df = ev(spark, sf_dir)
        height = df.select("height").first()["height"]
        nodes = sorted((graph.validate_node({"id": f"{k}-main", "type": k, "params": p}) for k, p in kinds.items()), key=lambda n: n.effect.stage)
        out = R.render(df, graph.plan(nodes, 100, height, quality=quality, fmt=fmt, frame=frame, band_pixels=1_000_000))
        return rounded(out.select("y", "x", *"rgb"), *"rgb")

    return q


def _up(low: str, out: str, s: int, columns: list[str], to: str = "ev") -> str:
    """Bilinear view of a reduced view over the pixels of `to`."""
    value = ", ".join(f"(1 - ty) * ((1 - tx) * a.{c} + tx * b.{c}) + ty * ((1 - tx) * c.{c} + tx * d.{c}) as {c}" for c in columns)
    return f"""{out}_p as (select y, x, (y + 0.5) / {s} - 0.5 as fy, (x + 0.5) / {s} - 0.5 as fx, (height + {s - 1}) // {s} - 1 as my, (width + {s - 1}) // {s} - 1 as mx from {to}),
{out}_q as (select *, greatest(0, cast(floor(fy) as bigint)) as y0, greatest(0, cast(floor(fx) as bigint)) as x0 from {out}_p), {out}_s as (select *, least(y0 + 1, my) as y1, least(x0 + 1, mx) as x1, fy - y0 as ty, fx - x0 as tx from {out}_q),
{out} as (select s.y, s.x, {value} from {out}_s s join {low} a on a.y = y0 and a.x = x0 join {low} b on b.y = y0 and b.x = x1 join {low} c on c.y = y1 and c.x = x0 join {low} d on d.y = y1 and d.x = x1)"""


def _blurred(src: str, out: str, sigma: float, scale: int, columns: list[str]) -> str:
    """The fast blur of a view with y, x, width, height, at a reduced size if scale isn't 1."""
    if scale == 1:
        r = stencil.box_radius(sigma)
        return box_sql(src, out, columns, r) if r else f"{out} as (select * from {src})"
    r = stencil.box_radius(sigma / scale)
    low = f"{out}_l as (select y // {scale} as y, x // {scale} as x, (any_value(width) + {scale - 1}) // {scale} as width, (any_value(height) + {scale - 1}) // {scale} as height, {', '.join(f'avg({c}) as {c}' for c in columns)} from {src} group by 1, 2)"
    blurred = box_sql(f"{out}_l", f"{out}_b", columns, r) if r else f"{out}_b as (select * from {out}_l)"
    return f"{low}, {blurred}, {_up(f'{out}_b', out, scale, columns)}"


_FRAME = (1200, 900)
_RADIUS = EFFECTS["bloom"].radius(EFFECTS["bloom"].defaults, {"width": _FRAME[0], "height": _FRAME[1]})
_BSRC = [f"greatest(0.0, {c}) * {ss('0.72', '1.44', 'greatest(r, g, b)')} * least(1.0, greatest(0.0, a))" for c in "rgb"]
_LOBES = []
for _k, (_name, _ratio, _w) in enumerate(EFFECTS["bloom"].lobes):
    _s = _RADIUS * _ratio
    _LOBES.append(_blurred("bs", f"lobe{_k}", _s, 1 if _name == "core" else (4 if _s >= 16 else 2) if _name == "mid" else (8 if _s >= 32 else 4), list("rgb")))
_BLOOM = f"""{EV}, b0 as (select y, x, width, height, {', '.join(f'{e} as {c}' for e, c in zip(_BSRC, 'rgb', strict=True))} from ev),
bs as (select y, x, width, height, {', '.join(f'greatest(0.0, {Y709} + ({c} - {Y709}) * 0.85) as {c}' for c in 'rgb')} from b0), {', '.join(_LOBES)},
glow as (select ev.y, ev.x, ev.r, ev.g, ev.b, {', '.join(f"(0.62 * lobe0.{c} + 0.28 * lobe1.{c} + 0.10 * lobe2.{c}) * 0.55 * (1 - 0.45 * {ss('0.72', '1.44', 'greatest(ev.r, ev.g, ev.b)')}) as g{c}" for c in 'rgb')}
  from ev join lobe0 on lobe0.y = ev.y and lobe0.x = ev.x join lobe1 on lobe1.y = ev.y and lobe1.x = ev.x join lobe2 on lobe2.y = ev.y and lobe2.x = ev.x)"""
query("bloom_crop", f"with {_BLOOM} select y, x, {sql_round(*(f'{c} + g{c} as {c}' for c in 'rgb'))} from glow")(_crop({"bloom": {}}, _FRAME))
_T = 0.18 * 2**2.5
query("bloom_protected_crop", f"with {_BLOOM} select y, x, {sql_round(*(f'{c} + g{c} * (1 - 0.5 * {ss(str(_T), str(2 * _T), "greatest(r, g, b)")}) as {c}' for c in 'rgb'))} from glow")(_crop({"bloom": {}, "highlightProtection": {}}, _FRAME))

_RES = {"width": 6000, "height": 4000, "format": {"gauge": "16mm", "iso": 250}}
_RS = EFFECTS["filmResolution"].sigma(EFFECTS["filmResolution"].params(None), _RES)
_EV2 = f"(log2(greatest(1e-6, {Y709}) / 0.18))"
_RW = f"least(1.5, greatest(0.0, 1 + 0.25 * (1 - {ss('-6', '-2', _EV2)}) + 0.15 * {ss('2', '6', _EV2)}))"


def _resolution_sql(blur) -> str:
    mix = [f"case when w <= 1 then k.{c} + w * (n.{c} - k.{c}) else (2 - w) * n.{c} + (w - 1) * m.{c} end as {c}" for c in "rgb"]
    return f"with {EV}, {blur('near', _RS)}, {blur('wide', 2.2 * _RS)}, k as (select *, {_RW} as w from ev) select y, x, {sql_round(*mix)} from k join (select y, x, {', '.join(f'{c}' for c in 'rgb')} from near) n using (y, x) join (select y, x, r, g, b from wide) m using (y, x)"


def _gauss(out: str, sigma: float) -> str:
    k = stencil.gaussian_kernel(sigma)
    return f"{out}_h as (select y, x, {', '.join(f'{_taps(k, c, "x", "y")} as {c}' for c in 'rgb')} from ev), {out} as (select y, x, {', '.join(f'{_taps(k, c, "y", "x")} as {c}' for c in 'rgb')} from {out}_h)"


query("film_resolution_crop_fast", _resolution_sql(lambda out, s: box_sql("ev", out, list("rgb"), stencil.box_radius(s))))(_crop({"filmResolution": {}}, (6000, 4000), {"gauge": "16mm"}))
query("film_resolution_crop", _resolution_sql(_gauss))(_crop({"filmResolution": {}}, (6000, 4000), {"gauge": "16mm"}, "quality"))

# the light-scattering node without growth, interior protection and hue response: source, three lobes a layer, gates, composite
_HP = EFFECTS["halation"].params({"strength": 60, "sigma": 6, "threshold": 0.6, "redTail": 0.3, "blueCompensation": 0.35, "colorDensity": 0.4, "amplify": 1.5, "globalDiffusion": 0})
_HL = []
for _i in range(3):
    for _k, (_ratio, _w) in enumerate(kernels.lobes(_HP, _i == 0)):
        _s = _HP["sigma"] * _HP["sigmaRatio"][_i] * _ratio
        _HL.append((_i, _k, _w, _blurred("hs", f"h{_i}{_k}", _s, 1 if _k == 0 else kernels.lobe_scale(_s, False), [f"s{_i}"])))
_t, _hs, _im = _HP["threshold"], _HP["hotSourceThreshold"], 1 + 1.5 * _HP["sourceImpact"]
_amp = [_HP["amplify"], 1 + (_HP["amplify"] - 1) * 0.55, 1 + (_HP["amplify"] - 1) * 0.15]
_peak = "greatest(0.0, r, g, b)"
_cool = f"(case when {_peak} > 1e-8 then greatest(0.0, greatest(0.0, b) - greatest(0.0, r)) / greatest({_peak}, 1e-8) else 0.0 end)"
_HALO = f"""{EV}, q0 as (select *, greatest(0.0, {Y709}) as e, {ss(str(_t - 0.025), str(_t + 0.025), Y709)} as mask, 1 - {ss(str(0.3 - 0.08), '0.3', 'least(1.0, greatest(0.0, 0.82 * r + 0.18 * g))')} as back from ev),
q1 as (select *, case when e <= {_t} then 0.0 when e <= 1 then (e - {_t}) / {1 - _t} else 1 + log2(e) end as u, back + (1 - back) * {_cool} * 0.35 as gate from q0),
q2 as (select *, mask * a * (8 * pow(u, {_im}) / (7 + pow(u, {_im}))) / greatest(e, 1e-8) as norm, {ss(str(_hs - 0.25), str(_hs + 0.25), 'u')} as hot from q1),
hs as (select *, greatest(0.0, 0.82 * r + 0.16 * g + 0.02 * b) * norm * {_amp[0]} as s0, greatest(0.0, 0.08 * r + 0.74 * g + 0.03 * b) * norm * (0.12 + 0.88 * hot) * {_amp[1]} as s1, greatest(0.0, 0.01 * r + 0.03 * g + 0.06 * b) * norm * {_amp[2]} as s2 from q2),
{', '.join(x[3] for x in _HL)},
sp as (select hs.*, {', '.join('(' + ' + '.join(f'{w} * h{i}{k}.s{i}' for i, k, w, _ in _HL if i == c) + f') * {_HP["redshift"][c]} as p{c}' for c in range(3))} from hs {' '.join(f'join h{i}{k} on h{i}{k}.y = hs.y and h{i}{k}.x = hs.x' for i, k, _, _ in _HL)}),
atn as (select *, 0.4 * (1 - hot + hot * {(1 - _HP["hotCoreStrength"]) ** 3}) as att from sp), lg as (select *, {', '.join(f'greatest(0.0, p{c} - att * s{c}) as k{c}' for c in range(3))} from atn),
gt as (select *, gate + (1 - gate) * greatest(hot, 1 - exp(-48 * k0)) * {_HP["hotCoreStrength"]} as gg from lg), en as (select *, k0 * gg * 1.2 as er, k1 * gg * 1.2 as eg, k2 * gg * 1.2 as eb, greatest(0.0, {Y709}) as l from gt),
cp as (select *, greatest(0.0, er - greatest(eg, eb)) as ex, least(1.0, greatest(0.0, (greatest(g, b) - r) / greatest(1e-8, r, g, b))) as cool, least(0.38, greatest(0.12, eg / greatest(er, 1e-8))) as gr, least(0.12, greatest(0.035, eb / greatest(er, 1e-8))) as br from en),
cm as (select *, least(0.78, 0.4 * (1 - exp(-6 * ex * (1 + 1.6 * 0.35 * cool))) * (1 - 0.86 * {ss('0', '1', '(l - 0.70) / 0.35')})) as m, least(l / greatest(1e-8, 0.2126 + 0.7152 * gr + 0.0722 * br), l * 2.4 + 0.05) as tr from cp),
cx as (select *, r + (tr - r) * m as cr, g + (tr * gr - g) * m as cg, b + (tr * br - b) * m as cb from cm), cz as (select *, greatest(0.0, l - (0.2126 * cr + 0.7152 * cg + 0.0722 * cb)) as lift, er <= 1e-12 or ex <= 1e-12 as plain from cx)"""
query("halation_crop", f"with {_HALO} select y, x, {sql_round(*(f'case when plain then {c} else c{c} + lift end + e{c} as {c}' for c in 'rgb'))} from cz")(_crop({"halation": {k: v for k, v in _HP.items() if k in ("strength", "sigma", "threshold", "redTail", "blueCompensation", "colorDensity", "amplify", "globalDiffusion")}}, _FRAME))


@query("halation_source", f"with {_HALO.split(', h00')[0].rsplit(',', 0)[0].split('h00_')[0].rstrip().rstrip(',')} select y, x, {sql_round('u as u', 's0 as s0', 's1 as s1', 's2 as s2')} from hs")
def halation_source(spark, sf_dir):
    return rounded(R.extracted(ev(spark, sf_dir), _HP, _HP["sigma"]).select("y", "x", "u", "s0", "s1", "s2"), "u", "s0", "s1", "s2")


# fast grain of one shared field: two sizes of hashed noise, each blurred over its own margin
_GP = EFFECTS["grain"].params({"chroma": 0, "mode": "fast", "seedMode": "fixed"})


def _grain_sql() -> str:
    views, fields = [], []
    for k, (weight, sigma) in enumerate(EFFECTS["grain"].scales(_GP, {"width": 6000, "height": 4000})):
        r = stencil.box_radius(sigma)
        kernel = [1.0]
        for _ in range(3):
            kernel = [sum(kernel[j] for j in range(max(0, i - 2 * r), min(len(kernel), i + 1))) / (2 * r + 1) for i in range(len(kernel) + 2 * r)]
        pad, first = 3 * r, rng.fmix32(rng.fmix32(_GP["seed"] ^ rng.GOLDEN) ^ rng.fnv1a("grain-main"))
        grid = f"n{k} as (select cast(v.range as integer) as y, cast(u.range as integer) as x, (v.range - {pad}) & 4294967295 as wy, (u.range - {pad}) & 4294967295 as wx, {100 + 2 * pad} as width, height + {2 * pad} as height from (select any_value(height) as height from ev) z, range(0, {100 + 2 * pad}) u, range(0, 20000) v where v.range < height + {2 * pad})"
        base = _mix(str(first), ["wx", "wy", str(k), "0"], f"n{k}", f"n{k}_")
        draws = [_mix("h0", [str(j)], f"(select *, h as h0 from {base[1]})", f"n{k}d{j}_") for j in range(12)]
        total = "cast(0 as float)"
        for d in draws:
            total = f"cast(cast({total} as double) + {d[1]}.h / 4294967296.0 as float)"
        z = f"n{k}z as (select {draws[0][1]}.y, {draws[0][1]}.x, {draws[0][1]}.width, {draws[0][1]}.height, cast(cast(cast({total} as double) - 6 as float) as double) as z from {draws[0][1]} " + " ".join(f"join {d[1]} using (y, x)" for d in draws[1:]) + ")"
        views += [grid, base[0], *(d[0] for d in draws), z, box_sql(f"n{k}z", f"n{k}f", ["z"], r)]
        fields.append((k, pad, f"{weight ** 0.5 / sum(c * c for c in kernel)!r} * n{k}f.z"))
    joins = " ".join(f"join n{k}f on n{k}f.y = ev.y + {pad} and n{k}f.x = ev.x + {pad}" for k, pad, _ in fields)
    envelope = f"(0.42 + 0.58 * exp(-0.5 * pow(((log2(greatest({Y709.replace('r', 'ev.r', 1)}, 1e-6) / 0.18)) + 0.5) / 2, 2)))"
    return f"""with {EV}, {', '.join(views)}, d as (select ev.*, {' + '.join(f for _, _, f in fields)} as f, ln(2) * 0.085 * {envelope.replace('ev.r', 'r')} as d from ev {joins}),
k as (select *, exp(least(20.0, greatest(-20.0, d * f - 0.5 * d * d))) as k from d) select y, x, {sql_round(*(f'{c} + a * ({c} * k - {c}) as {c}' for c in 'rgb'))} from k"""


query("grain_crop_fast", _grain_sql())(_crop({"grain": {"chroma": 0, "seedMode": "fixed"}}, (6000, 4000)))
