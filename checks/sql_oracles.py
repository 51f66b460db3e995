"""One DuckDB statement per query of the catalogue.

Statements are put together from named building blocks; ``statement`` adds the
blocks a query uses, directly or through other blocks, as a WITH list.
"""

from __future__ import annotations

import math
import re

from urbanweave.functions import display
from urbanweave.functions.areas import AREA_NAMES
from urbanweave.functions.hexgrid import (
    BASE_CELL,
    FACE_AXIS_AZIMUTH,
    FACE_CENTRE_LAT,
    FACE_CENTRE_LNG,
    GNOMONIC_UNIT,
    ODD_RESOLUTION_ROTATION,
)
from urbanweave.plans import catalogue as c
from urbanweave.plans.cube_queries import CUBE_QUERIES
from urbanweave.plans.job_queries import SCOPE
from urbanweave.schemas import FEATURE_TRIP, TRIP

BLOCKS: dict[str, str] = {}

# Federal holidays and observed days of the years the sample covers.
HOLIDAYS = """
    2023-01-02 2023-01-16 2023-02-20 2023-05-29 2023-06-19 2023-07-04 2023-09-04 2023-10-09
    2023-11-10 2023-11-11 2023-11-23 2023-12-25 2024-01-01 2024-01-15 2024-02-19 2024-05-27
    2024-06-19 2024-07-04 2024-09-02 2024-10-14 2024-11-11 2024-11-28 2024-12-25 2025-01-01
    2025-01-20 2025-02-17 2025-05-26 2025-06-19 2025-07-04 2025-09-01 2025-10-13 2025-11-11
    2025-11-27 2025-12-25 2026-01-01 2026-01-19 2026-02-16 2026-05-25
""".split()


def avg2(expression: str, digits: int = 2) -> str:
    return f"cast(round(cast(avg({expression}) as decimal(38,10)), {digits}) as double)"


def _typed(names: dict[str, str], kinds: str) -> str:
    parts = []
    for field in TRIP.fields:
        kind = {"string": "varchar", "double": "double", "timestamp_ntz": "timestamp"}[field.dataType.simpleString()]
        kind = kinds or kind
        parts.append(f"cast({names.get(field.name, 'null')} as {kind}) as {field.name}")
    return ",\n  ".join(parts)


_STOP = "cast(json_extract_string(props, '$.k') as bigint) % 41"
_TRIP_COLUMNS = {
    "trip_id": "'t' || event_id::varchar",
    "trip_start_timestamp": "ts + to_days(cast(event_id % 730 as integer))",
    "trip_end_timestamp": "ts + to_days(cast(event_id % 730 as integer)) + to_seconds(event_id * 37 % 9000 - 60)",
    "trip_seconds": "case when event_id % 41 = 0 then null else (event_id * 37 % 9000)::double end",
    "trip_miles": "case when event_id % 43 = 0 then null else (event_id * 7 % 1050)::double / 8 end",
    "fare": "case when event_id % 53 = 0 then null else value end",
    "tips": "case when event_id % 47 = 0 then null else (event_id % 9)::double end",
    "pickup_community_area": "(user_id % 80)::double",
    "pickup_centroid_latitude": "41.57::double + (user_id % 41)::double * 0.0129::double",
    "pickup_centroid_longitude": "-87.89::double + (user_id % 41 * 7 % 41)::double * 0.0095::double",
    "dropoff_centroid_latitude": f"41.57::double + ({_STOP})::double * 0.0129::double",
    "dropoff_centroid_longitude": f"-87.89::double + (({_STOP}) * 7 % 41)::double * 0.0095::double",
}
BLOCKS["trips"] = f"select {_typed(_TRIP_COLUMNS, '')} from events"

_DIRTY = dict(_TRIP_COLUMNS)
_DIRTY["trip_id"] = """case when event_id % 97 = 0 then null
    when event_id % 10 = 3 then 't' || (event_id - 1)::varchar else 't' || event_id::varchar end"""
_DIRTY["trip_start_timestamp"] = (
    f"case when event_id % 59 = 0 then 'not a time' else ({_TRIP_COLUMNS['trip_start_timestamp']})::varchar end"
)
_DIRTY["trip_miles"] = (
    "case when event_id % 61 = 0 then '12d' when event_id % 67 = 0 then 'NaN' "
    f"else ({_TRIP_COLUMNS['trip_miles']})::varchar end"
)
_DIRTY["pickup_centroid_latitude"] = (
    "case when event_id % 29 = 0 then ' ' when event_id % 31 = 0 then 'n/a' when event_id % 37 = 0 then null "
    f"else ({_TRIP_COLUMNS['pickup_centroid_latitude']})::varchar end"
)
_DIRTY["tolls"] = "case when event_id % 71 = 0 then 'n/a' when event_id % 73 = 0 then '1.5' end"
BLOCKS["landed"] = f"select {_typed(_DIRTY, 'varchar')} from events"


def number(name: str) -> str:
    return (
        f"case when regexp_full_match({name}, '\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*') "
        f"then try_cast(trim({name}) as double) end"
    )


# Positions and times cast, as the landing clean-up does; measures stay text.
BLOCKS["landed_cast"] = f"""
select * replace (
  try_cast(trip_start_timestamp as timestamp) as trip_start_timestamp,
  try_cast(trip_end_timestamp as timestamp) as trip_end_timestamp,
  {number('pickup_centroid_latitude')} as pickup_centroid_latitude,
  {number('pickup_centroid_longitude')} as pickup_centroid_longitude,
  {number('dropoff_centroid_latitude')} as dropoff_centroid_latitude,
  {number('dropoff_centroid_longitude')} as dropoff_centroid_longitude)
from landed"""
BLOCKS["landed_typed"] = f"""
select * replace ({number('trip_miles')} as trip_miles, {number('trip_seconds')} as trip_seconds, {number('fare')} as fare)
from landed_cast"""
_FIRST_COPY = "row_number() over (partition by trip_id order by trip_start_timestamp nulls last, trip_end_timestamp) = 1"
BLOCKS["landed_clean"] = f"""
select * from landed_cast
where pickup_centroid_latitude is not null and pickup_centroid_longitude is not null
  and dropoff_centroid_latitude is not null and dropoff_centroid_longitude is not null
qualify {_FIRST_COPY}"""

_FAILED = """case
  when not coalesce(pickup_centroid_latitude between 41.6 and 42.1 and pickup_centroid_longitude between -87.9 and -87.5
    and dropoff_centroid_latitude between 41.6 and 42.1 and dropoff_centroid_longitude between -87.9 and -87.5, false)
    then 'invalid_coordinates'
  when trip_miles not between 0 and 100 then 'invalid_trip_miles'
  when trip_seconds not between 60 and 7200 then 'invalid_trip_seconds'
  when fare not between 2.5 and 500 then 'invalid_fare'
  when trip_end_timestamp < trip_start_timestamp then 'invalid_timestamps' end"""
BLOCKS["judged"] = f"select *, {_FAILED} as failed from trips"
BLOCKS["clean"] = "select * exclude (failed) from judged where failed is null"

BLOCKS["areas"] = "select * from (values " + ", ".join(
    "({}, '{}')".format(n, name.replace("'", "''")) for n, name in enumerate(AREA_NAMES, start=1)
) + ") a(area, neighborhood)"
BLOCKS["holidays"] = "select unnest([" + ", ".join(f"date '{d}'" for d in HOLIDAYS) + "]) as holiday"

_CALENDAR = """
  hour(trip_start_timestamp)::integer as hour, (isodow(trip_start_timestamp) - 1)::integer as day_of_week,
  month(trip_start_timestamp)::integer as month,
  (isodow(trip_start_timestamp) >= 6)::integer as is_weekend,
  (hour(trip_start_timestamp) in (7, 8, 9, 17, 18, 19))::integer as is_rush_hour,
  case month(trip_start_timestamp) // 3 % 4 when 0 then 'Winter' when 1 then 'Spring' when 2 then 'Summer' else 'Fall' end as season,
  (trip_start_timestamp::date in (select holiday from holidays))::integer as is_holiday"""
_FARES = """
  case when trip_seconds > 0 then trip_miles / (trip_seconds / 3600) end as speed_mph,
  case when trip_miles > 0 then fare / trip_miles end as fare_per_mile,
  case when fare > 0 then tips / fare * 100 end as tip_percentage,
  fare + tips as total_amount"""
BLOCKS["wide"] = f"select t.*, {_CALENDAR}, {_FARES}, a.neighborhood from clean t left join areas a on a.area = t.pickup_community_area"

# What the landing job writes: months up to the day of the run, and the rows without a time as one month.
_MONTH_COPY = """row_number() over (partition by year(trip_start_timestamp), month(trip_start_timestamp), trip_id
  order by trip_start_timestamp nulls last, trip_end_timestamp) = 1"""
BLOCKS["job_rows"] = f"""
select * replace ({number('tolls')} as tolls, {number('tips')} as tips, {number('pickup_community_area')} as pickup_community_area)
from landed_typed
where pickup_centroid_latitude is not null and pickup_centroid_longitude is not null
  and dropoff_centroid_latitude is not null and dropoff_centroid_longitude is not null
  and (trip_start_timestamp is null or
    trip_start_timestamp >= timestamp '2022-01-01' and date_trunc('month', trip_start_timestamp) <= timestamp '{c.TODAY}')
qualify {_MONTH_COPY}"""
BLOCKS["job_judged"] = f"select *, {_FAILED} as failed from job_rows"
BLOCKS["job_kept"] = "select * exclude (failed) from job_judged where failed is null"
BLOCKS["job_wide"] = f"select t.*, {_CALENDAR}, {_FARES}, a.neighborhood from job_kept t left join areas a on a.area = t.pickup_community_area"

# Cells, from azimuth and distance to the face centre, then level by level.
_AXIS = FACE_AXIS_AZIMUTH - ODD_RESOLUTION_ROTATION
_GROW = math.sqrt(7) ** 9 / GNOMONIC_UNIT
BLOCKS["points"] = """
select distinct lat, lon from (
  select pickup_centroid_latitude as lat, pickup_centroid_longitude as lon from trips
  union all select dropoff_centroid_latitude, dropoff_centroid_longitude from trips)"""
BLOCKS["polar"] = f"""
select lat, lon,
  {_AXIS!r}::double - atan2(cos(radians(lat)) * sin(radians(lon) - ({FACE_CENTRE_LNG!r})),
    cos({FACE_CENTRE_LAT!r}) * sin(radians(lat)) - sin({FACE_CENTRE_LAT!r}) * cos(radians(lat)) * cos(radians(lon) - ({FACE_CENTRE_LNG!r}))) as theta,
  tan(acos(sin({FACE_CENTRE_LAT!r}) * sin(radians(lat)) + cos({FACE_CENTRE_LAT!r}) * cos(radians(lat)) * cos(radians(lon) - ({FACE_CENTRE_LNG!r})))) * {_GROW!r} as reach
from points"""
BLOCKS["planar"] = """
select lat, lon, reach * cos(theta) + reach * sin(theta) / sqrt(3) as a, 2 * reach * sin(theta) / sqrt(3) as b from polar"""
BLOCKS["snapped"] = """
select lat, lon,
  case when abs(round(a) - a) > abs(round(b) - b) and abs(round(a) - a) > abs(round(b - a) - (b - a))
    then round(b) - round(b - a) else round(a) end::bigint as a9,
  case when abs(round(b) - b) >= abs(round(a) - a) and abs(round(b) - b) > abs(round(b - a) - (b - a))
    then round(a) + round(b - a) else round(b) end::bigint as b9
from planar"""
_above = "snapped"
for _level in range(9, 0, -1):
    _up = ("3*a{0} - b{0}", "a{0} + 2*b{0}") if _level % 2 else ("2*a{0} + b{0}", "3*b{0} - a{0}")
    _pa, _pb = (f"round(({u.format(_level)}) / 7.0)::bigint" for u in _up)
    BLOCKS[f"level{_level - 1}"] = f"select *, {_pa} as a{_level - 1}, {_pb} as b{_level - 1} from {_above}"
    _above = f"level{_level - 1}"


def _digit(level: int) -> str:
    centre = (
        f"(2*a{level - 1} + b{level - 1})", f"(3*b{level - 1} - a{level - 1})"
    ) if level % 2 else (f"(3*a{level - 1} - b{level - 1})", f"(a{level - 1} + 2*b{level - 1})")
    da, db = f"(a{level} - {centre[0]})", f"(b{level} - {centre[1]})"
    return f"(4*{da} + 2*{db} - 7*least(0, {da}, {db}))"


_DIGITS = " + ".join(f"{_digit(level)} * {8 ** (9 - level)}" for level in range(1, 10))
BLOCKS["cells"] = f"""
select lat, lon, a9, b9,
  lower(to_hex(({(1 << 59) + (9 << 52) + (BASE_CELL << 45) + (1 << 18) - 1})::bigint + ({_DIGITS})::bigint * {1 << 18})) as cell
from level0 where a0 = -1 and b0 = 0"""
_CELL_JOIN = """
left join cells p on p.lat = t.pickup_centroid_latitude and p.lon = t.pickup_centroid_longitude
left join cells d on d.lat = t.dropoff_centroid_latitude and d.lon = t.dropoff_centroid_longitude"""
BLOCKS["celled"] = f"""
select t.*, p.cell as pickup_h3, d.cell as dropoff_h3,
  greatest(abs(p.a9 - d.a9), abs(p.b9 - d.b9), abs((p.a9 - d.a9) - (p.b9 - d.b9)))::double as h3_distance
from wide t {_CELL_JOIN}"""

BLOCKS["edges"] = """
select pickup_h3, dropoff_h3, count(*) as weight from celled
where pickup_h3 <> dropoff_h3 group by all having count(*) >= 5"""
BLOCKS["job_edges"] = f"""
select p.cell as pickup_h3, d.cell as dropoff_h3, count(*) as weight from job_wide t {_CELL_JOIN}
where p.cell <> d.cell group by all having count(*) >= 5"""
BLOCKS["nodes"] = "select pickup_h3 as h3_cell from edges union select dropoff_h3 from edges"
BLOCKS["strength"] = """
select h3_cell, in_strength, out_strength, in_strength + out_strength as total_flow from (
  select h3_cell,
    coalesce((select sum(weight) from edges where dropoff_h3 = h3_cell), 0)::double as in_strength,
    coalesce((select sum(weight) from edges where pickup_h3 = h3_cell), 0)::double as out_strength
  from nodes)"""
# The textbook iteration: nodes without outgoing edges link to all nodes.
BLOCKS["steps"] = """
select pickup_h3 as src, dropoff_h3 as dst, weight / sum(weight) over (partition by pickup_h3) as share from edges
union all select n.h3_cell, m.h3_cell, 1.0 / (select count(*) from nodes) from nodes n, nodes m
  where n.h3_cell not in (select pickup_h3 from edges)
union all select h3_cell, h3_cell, 0 from nodes"""
BLOCKS["walk"] = """
select 0 as round, h3_cell, 1.0::double / (select count(*) from nodes) as score from nodes
union all
select w.round + 1, s.dst, 0.15 / (select count(*) from nodes) + 0.85 * sum(w.score * s.share)
from walk w join steps s on w.h3_cell = s.src where w.round < 80 group by w.round, s.dst"""
BLOCKS["ranked"] = "select h3_cell, score as pagerank from walk where round = 80"


def _betweenness_blocks(prefix: str, length: str, kind: str, same: str) -> None:
    BLOCKS[f"{prefix}arcs"] = f"select pickup_h3 as u, dropoff_h3 as v, {length} as len from edges"
    BLOCKS[f"{prefix}relax"] = f"""
select 0 as round, h3_cell as s, h3_cell as v, 0::{kind} as d from nodes
union all
select round + 1, s, v, min(d) from (
  select r.round, r.s, r.v, r.d from {prefix}relax r
  union all select r.round, r.s, e.v, r.d + e.len from {prefix}relax r join {prefix}arcs e on e.u = r.v)
where round < 30 group by round, s, v"""
    BLOCKS[f"{prefix}dist"] = f"select s, v, d from {prefix}relax where round = 30"
    BLOCKS[f"{prefix}dag"] = f"""
select x.s, e.u, e.v from {prefix}dist x join {prefix}arcs e on e.u = x.v join {prefix}dist y on y.s = x.s and y.v = e.v
where {same} and x.d < y.d"""
    BLOCKS[f"{prefix}waves"] = f"""
select 0 as k, h3_cell as s, h3_cell as v, 1::double as n from nodes
union all
select w.k + 1, w.s, g.v, sum(w.n) from {prefix}waves w join {prefix}dag g on g.s = w.s and g.u = w.v group by w.k, w.s, g.v"""
    BLOCKS[f"{prefix}paths"] = f"select s, v, sum(n) as n from {prefix}waves group by s, v"
    BLOCKS[f"{prefix}back"] = f"""
select 0 as k, s, v as u, 1::double as score from {prefix}paths where s <> v
union all
select b.k + 1, b.s, g.u, sum(b.score * t.n / h.n)
from {prefix}back b join {prefix}dag g on g.s = b.s and g.v = b.u and g.u <> g.s
  join {prefix}paths t on t.s = g.s and t.v = g.u join {prefix}paths h on h.s = g.s and h.v = g.v
group by b.k, b.s, g.u"""
    BLOCKS[f"{prefix}between"] = f"""
select h3_cell, coalesce((select sum(score) from {prefix}back b where k > 0 and b.u = h3_cell), 0)::double as betweenness from nodes"""


_betweenness_blocks("w_", "weight::bigint", "bigint", "x.d + e.len = y.d")
_betweenness_blocks("i_", "1.0::double / weight", "double", "abs(x.d + e.len - y.d) <= 1e-9 * y.d")

BLOCKS["metrics"] = """
select s.h3_cell, s.in_strength, s.out_strength, s.total_flow, round(r.pagerank, 7) as pagerank,
  round(b.betweenness, 6) as betweenness,
  round(case when max(b.betweenness) over () > 0 then b.betweenness / max(b.betweenness) over () else 0 end, 7) as betweenness_norm,
  (row_number() over (order by s.total_flow desc, s.h3_cell))::integer as rank
from strength s join ranked r using (h3_cell) join w_between b using (h3_cell)"""
BLOCKS["districts"] = """
select h3_cell, number::integer as community, size::integer as community_size
from nodes join (
  select left(h3_cell, 7) as label, count(*) as size,
    row_number() over (order by count(*) desc, min(h3_cell)) - 1 as number
  from nodes group by 1) on label = left(h3_cell, 7)"""
BLOCKS["pairs"] = """
select least(pickup_h3, dropoff_h3) as cell_a, greatest(pickup_h3, dropoff_h3) as cell_b, sum(weight)::bigint as weight
from edges group by 1, 2"""
BLOCKS["spread"] = """
select 0 as round, h3_cell, h3_cell as part from nodes
union all
select round + 1, h3_cell, min(part) from (
  select round, h3_cell, part from spread
  union all
  select s.round, n.b, s.part from spread s join (
    select cell_a as a, cell_b as b from pairs union all select cell_b, cell_a from pairs) n on n.a = s.h3_cell
  join districts x on x.h3_cell = n.a join districts y on y.h3_cell = n.b and x.community = y.community)
where round < 40 group by round, h3_cell"""
BLOCKS["usual"] = f"""
select pickup_h3 as h3_cell, {avg2('total_amount')} as avg_ticket, {avg2('trip_miles')} as avg_miles,
  (select neighborhood from (select neighborhood, count(*) as n from celled i
     where i.pickup_h3 = o.pickup_h3 and neighborhood is not null group by 1 order by n desc, 1 limit 1)) as neighborhood
from celled o where pickup_h3 is not null group by pickup_h3"""
BLOCKS["leader"] = "select h3_cell as leader from strength order by total_flow desc, h3_cell limit 1"
BLOCKS["calendar"] = f"""
select year(d)::integer as year, month(d)::integer as month
from generate_series(timestamp '2022-01-01', timestamp '{c.TODAY}', interval 1 month) g(d)"""


def _month_counts(source: str) -> str:
    return (
        "select year(trip_start_timestamp)::integer as year, month(trip_start_timestamp)::integer as month, "
        f"count(*) as records from {source} where trip_start_timestamp is not null group by 1, 2"
    )


BLOCKS["clean_months"] = _month_counts("clean")
BLOCKS["trip_months"] = _month_counts("trips")


def _log(months: str, counts: str, at: str) -> str:
    return f"""select m.year, m.month, coalesce(n.records, 0)::bigint as records,
  case when coalesce(n.records, 0) = 0 then 'empty' else 'ok' end as status,
  cast(null as double) as elapsed_seconds, '{at}' as downloaded_at
from ({months}) m left join {counts} n using (year, month)"""


RECURSIVE = {"walk", "spread"} | {f"{p}{n}" for p in ("w_", "i_") for n in ("relax", "waves", "back")}


def statement(final: str) -> str:
    """``final`` with the blocks it needs, in the order they are defined."""
    needed: set[str] = set()
    open_texts = [final]
    while open_texts:
        words = set(re.findall(r"\w+", open_texts.pop()))
        for name in words & BLOCKS.keys() - needed:
            needed.add(name)
            open_texts.append(BLOCKS[name])
    if not needed:
        return final
    listed = ",\n".join(
        f"{name} as {'' if name in RECURSIVE else 'materialized '}({text.strip()})"
        for name, text in BLOCKS.items()
        if name in needed
    )
    return f"with recursive {listed}\n{final}"


_PARTS = "year(trip_start_timestamp)::integer as year, month(trip_start_timestamp)::integer as month"


def _counts(rows: str, *keys: str) -> str:
    return f"select {', '.join(keys)}, count(*) as trips from {rows} group by all"


_JSON_HOURS = (
    "select to_json(list({{'{0}': {0}, 'trips': trips}} order by {0}))::varchar from "
    "(select {0}, count(*) as trips from {1} where {0} is not null group by 1)"
)
_QUALITY = """
  count(*) as rows_raw, count(*) filter (failed is null) as rows_clean,
  count(*) filter (failed = 'invalid_coordinates') as invalid_coordinates,
  count(*) filter (failed = 'invalid_trip_miles') as invalid_trip_miles,
  count(*) filter (failed = 'invalid_trip_seconds') as invalid_trip_seconds,
  count(*) filter (failed = 'invalid_fare') as invalid_fare,
  count(*) filter (failed = 'invalid_timestamps') as invalid_timestamps"""


def _even2(value: str) -> str:
    return f"cast(round_even(cast({value} as decimal(38,10)), 2) as double)"


def _pct(part: str) -> str:
    return f"{_even2(f'{part} / rows_raw * 100')}"


_N = c.NEIGHBORHOOD
_GENERAL = f"""neighborhood, count(*) as total_trips, {avg2('total_amount')} as avg_ticket, {avg2('trip_miles')} as avg_miles,
  {avg2('trip_seconds / 60.0')} as avg_duration_min, {avg2('speed_mph')} as avg_speed_mph, {avg2('tip_percentage')} as avg_tip_pct,
  count(*) filter (is_weekend = 1) as weekend_trips, count(*) filter (is_rush_hour = 1) as rush_trips"""
_TOP_HEX = """h3_cell, total_flow, in_strength, out_strength, pagerank, betweenness_norm, rank, community, neighborhood, avg_ticket, avg_miles
from metrics left join districts using (h3_cell) left join usual using (h3_cell)"""
_BREAKDOWNS = " union all ".join(
    f"select '{name}' as breakdown, {key}::varchar as key, count(*) as trips from wide group by {key}"
    for name, key in (
        ("hourly_flow", "hour"), ("weekend_flow", "is_weekend"), ("rush_flow", "is_rush_hour"), ("seasonal_flow", "season")
    )
)


def _report(rows: str, n: int) -> str:
    lists = ", ".join(
        f"({_JSON_HOURS.format(key, rows)}) as {name}"
        for name, key in (
            ("hourly_flow", "hour"), ("weekend_flow", "is_weekend"), ("rush_flow", "is_rush_hour"), ("seasonal_flow", "season")
        )
    )
    top = f"select pickup_h3, count(*) as n from celled where pickup_h3 is not null group by 1 order by 2 desc, 1 limit {n}"
    return f"select {lists}, (select to_json(list(pickup_h3 order by n desc, pickup_h3))::varchar from ({top})) as top_h3_cells"


_NULLS = " union all ".join(
    f"select year(try_cast(trip_start_timestamp as timestamp))::integer as year, '{f.name}' as \"column\", "
    f"count(*) filter ({f.name} is null) as nulls, count(*) as n from landed group by 1"
    for f in TRIP.fields
)


def _describe(name: str) -> str:
    stats = {
        "mean": f"avg({name})", "std": f"stddev_samp({name})", "min": f"min({name})",
        "p25": f"quantile_cont({name}, 0.25)", "p50": f"quantile_cont({name}, 0.5)",
        "p75": f"quantile_cont({name}, 0.75)", "max": f"max({name})",
    }
    rounded = ", ".join(f"cast(round(cast({e} as decimal(38,10)), 6) as double) as {k}" for k, e in stats.items())
    year = "year(trip_start_timestamp)::integer"
    return f"select {year} as year, '{name}' as \"column\", count({name}) as count, {rounded} from trips group by 1 having count({name}) > 0"


def _color(level: str, steps, rest: str) -> str:
    return "case " + " ".join(f"when {level} > {t} then '{color}'" for t, color in steps) + f" else '{rest}' end"


# Corner positions by inverse projection of the lattice, independent of the cell text.
_CORNERS = ((2, 1), (1, 2), (-1, 1), (-2, -1), (-1, -2), (1, -1))
BLOCKS["spots"] = "select distinct p.cell as h3_cell, p.a9, p.b9 from clean t join cells p on p.lat = t.pickup_centroid_latitude and p.lon = t.pickup_centroid_longitude"


def _position(a: str, b: str, source: str, extra: str) -> str:
    x, y = f"(({a}) - ({b}) / 2.0)", f"(({b}) * sqrt(3) / 2.0)"
    return f"""
select {extra} degrees(asin(sl)) as lat, degrees({FACE_CENTRE_LNG!r} + atan2(sin(az) * sin(r) * cos({FACE_CENTRE_LAT!r}), cos(r) - sin({FACE_CENTRE_LAT!r}) * sl)) as lon
from (select *, sin({FACE_CENTRE_LAT!r}) * cos(r) + cos({FACE_CENTRE_LAT!r}) * sin(r) * cos(az) as sl
  from (select *, atan(sqrt({x}*{x} + {y}*{y}) / {_GROW!r}) as r, {_AXIS!r}::double - atan2({y}, {x}) as az from {source}))"""


BLOCKS["corner_list"] = "select * from (values " + ", ".join(
    f"({n}, {a}, {b})" for n, (a, b) in enumerate(_CORNERS)
) + ") k(corner, ca, cb)"
BLOCKS["corners"] = _position("a9 + ca / 3.0::double", "b9 + cb / 3.0::double", "(select * from spots, corner_list)", "h3_cell, corner,")


def _r7(name: str) -> str:
    return f"cast(round(cast({name} as decimal(38,10)), 7) as double) as {name}"


_DISTRICT_DEGREES = """
select community, sum(inside) as inside, sum(degree) as degree from (
  select x.community, case when x.community = y.community then weight else 0 end as inside, weight as degree
    from pairs join districts x on x.h3_cell = cell_a join districts y on y.h3_cell = cell_b
  union all
  select y.community, 0, weight from pairs join districts y on y.h3_cell = cell_b) group by 1"""

FINALS: dict[str, str] = {
    "month_scan": """select trip_id, trip_start_timestamp, fare from landed
        where try_cast(trip_start_timestamp as timestamp) >= timestamp '2024-12-01'
          and try_cast(trip_start_timestamp as timestamp) < timestamp '2025-01-01'""",
    "source_routing": """select origin, year, count(*) as trips from (
          select 'historical' as origin, year(trip_start_timestamp - interval 1 year)::integer as year from landed_typed
          union all select 'current', year(trip_start_timestamp)::integer from landed_typed)
        where (origin = 'historical') = (year < 2024) group by all""",
    "latest_trips": "select trip_id, trip_start_timestamp from trips order by trip_start_timestamp desc, trip_id limit 100",
    "trip_cast_clean": "select * from landed_clean",
    "dedup_first": f"select trip_id, trip_start_timestamp from landed_typed qualify {_FIRST_COPY}",
    "load_dedup": """select trip_id, trip_start_timestamp, tips::double as tips from landed_clean
        where trip_id is not null and trip_id not in (
          select trip_id from landed_clean where trip_id is not null and month(trip_start_timestamp) = 1)""",
    "ingest_loss": """select original, kept, original - kept as removed,
          cast(round(cast((original - kept) / original * 100 as decimal(38,10)), 6) as double) as pct_removed
        from (select (select count(*) from landed) as original, (select count(*) from landed_clean) as kept)""",
    "incremental_months": "select year, month from calendar where (year, month) not in (select (year, month) from clean_months)",
    "run_log": _log("select * from calendar", "clean_months", c.LOGGED_AT),
    "log_merge": _log("select * from calendar where year <> 2025", "trip_months", c.LOGGED_AT)
    + " union all "
    + _log("select * from calendar where year = 2025", "clean_months", c.RELOGGED_AT),
    "run_totals": """select
          coalesce(sum(n.records) filter (m.year >= 2023 and m.month <> 7), 0)::bigint as total_records,
          count(*) filter (m.year < 2023) as skipped, count(*) filter (m.year >= 2023 and m.month = 7) as errors
        from calendar m left join clean_months n using (year, month)""",
    "data_range": "select min(trip_start_timestamp) as oldest, max(trip_start_timestamp) as newest from trips",
    "feature_table": f"select {', '.join(FEATURE_TRIP.names)} from celled",
    "clean_rule_counts": "select coalesce(failed, 'clean') as rule, count(*) as rows from judged group by 1",
    "clean_trips": "select trip_id, trip_start_timestamp, trip_miles, trip_seconds, fare from clean",
    "quality_report": f"""select file, rows_raw, rows_clean, invalid_coordinates, invalid_trip_miles, invalid_trip_seconds,
          invalid_fare, invalid_timestamps, rows_raw - rows_clean as removed_total,
          {_pct('(rows_raw - rows_clean)')} as pct_removed, {_pct('invalid_coordinates')} as pct_coordinates,
          {_pct('invalid_trip_miles')} as pct_miles, {_pct('invalid_trip_seconds')} as pct_seconds,
          {_pct('invalid_fare')} as pct_fare, {_pct('invalid_timestamps')} as pct_timestamps
        from (select strftime(trip_start_timestamp, 'year=%Y/month=%m/data.parquet') as file, {_QUALITY} from judged group by 1
          union all select 'TOTAL', {_QUALITY} from judged)""",
    "profile_shape": "select year(trip_start_timestamp)::integer as year, count(*) as rows, 21 as columns from landed_typed group by 1",
    "profile_nulls": f'select year, "column", nulls, {_even2("nulls / n * 100")} as pct from ({_NULLS}) where nulls > 0',
    "profile_issues": """select year(trip_start_timestamp)::integer as year, count(*) as rows,
          count(*) filter (pickup_centroid_latitude not between 41.6 and 42.1 or pickup_centroid_longitude not between -87.9 and -87.5) as invalid_coordinates,
          count(*) filter (bad) as outliers,
          count(*) filter (trip_end_timestamp < trip_start_timestamp) as time_inconsistencies,
          cast(round(cast(count(*) filter (bad) / count(*) * 100 as decimal(38,10)), 2) as double) as outlier_pct
        from (select *, trip_miles < 0 or trip_miles >= 100 or trip_seconds < 60 or trip_seconds > 7200 or fare < 2.5 or fare > 500 as bad from landed_typed)
        group by 1""",
    "profile_duplicates": """select year, coalesce(sum(n) filter (n > 1), 0)::bigint as duplicate_rows
        from (select year(trip_start_timestamp)::integer as year, trip_id, count(*) as n from landed_typed group by all) group by year""",
    "describe_trips": " union all ".join(_describe(name) for name in c.DESCRIBED),
    "calendar_features": f"select trip_id, {_CALENDAR} from trips",
    "holiday_trips": "select trip_start_timestamp::date as day, count(*) as trips from trips where trip_start_timestamp::date in (select holiday from holidays) group by 1",
    "fare_features": f"select trip_id, {_FARES} from trips",
    "neighborhood_lookup": "select trip_id, pickup_community_area, neighborhood from trips left join areas on area = pickup_community_area",
    "trip_cells": "select trip_id, pickup_h3, dropoff_h3, h3_distance from celled",
    "point_cells": "select cell as h3_cell, count(*) as trips from trips left join cells on lat = pickup_centroid_latitude and lon = pickup_centroid_longitude group by 1",
    "pair_distances": "select distinct pickup_h3, dropoff_h3, h3_distance::integer as steps from celled semi join edges using (pickup_h3, dropoff_h3)",
    "cell_centres": f"select h3_cell, {_r7('lat')}, {_r7('lon')} from ({_position('a9', 'b9', 'spots', 'h3_cell,')})",
    "cell_boundaries": f"select h3_cell, corner, {_r7('lat')}, {_r7('lon')} from corners",
    "table_counts": """select 'taxi_trips' as "table", (select count(*) from clean) as rows
        union all select 'node_metrics', (select count(*) from nodes)
        union all select 'communities', (select count(*) from nodes)
        union all select 'edge_list', (select count(*) from edges)""",
    "summary": f"""select count(*) as total_trips, min(trip_start_timestamp) as period_start, max(trip_start_timestamp) as period_end,
          count(distinct neighborhood) as total_neighborhoods, count(distinct pickup_h3) as total_h3_cells,
          {avg2('total_amount')} as avg_ticket, {avg2('trip_miles')} as avg_miles, {avg2('trip_seconds / 60.0')} as avg_duration_min from celled""",
    "neighborhoods": f"""select neighborhood, count(*) as total_trips, {avg2('total_amount')} as avg_ticket, {avg2('trip_miles')} as avg_miles,
          {avg2('speed_mph')} as avg_speed_mph, {avg2('tip_percentage')} as avg_tip_pct
        from wide where neighborhood is not null group by 1""",
    "neighborhood_general": f"select {_GENERAL} from wide where neighborhood = '{_N}' group by 1",
    "neighborhood_detail": f"""select {_GENERAL},
          ({_JSON_HOURS.format('hour', f"(select * from wide where neighborhood = '{_N}')")}) as hourly,
          ({_JSON_HOURS.format('day_of_week', f"(select * from wide where neighborhood = '{_N}')")}) as weekly
        from wide where neighborhood = '{_N}' group by 1""",
    "flow_hourly": _counts("wide", "hour"),
    "flow_hourly_filtered": _counts(f"wide where neighborhood = '{_N}' and season = '{c.SEASON}'", "hour"),
    "flow_weekly": _counts("wide", "day_of_week"),
    "flow_weekly_filtered": _counts(f"wide where neighborhood = '{_N}'", "day_of_week"),
    "flow_seasonal": f"select season, count(*) as trips, {avg2('total_amount')} as avg_ticket from wide group by 1",
    "flow_rush": f"select is_rush_hour, count(*) as trips, {avg2('total_amount')} as avg_ticket, {avg2('trip_miles')} as avg_miles from wide group by 1",
    "top5_trips": "select neighborhood, count(*) as trips from wide where neighborhood is not null group by 1 order by trips desc, neighborhood limit 5",
    "top5_ticket": f"select neighborhood, {avg2('total_amount')} as avg_ticket from wide where neighborhood is not null and total_amount > 0 group by 1 order by avg_ticket desc, neighborhood limit 5",
    "temporal_breakdowns": f"select * from ({_BREAKDOWNS}) where key is not null",
    "temporal_report": _report("celled", 20),
    "temporal_report_top": _report(
        "(select * from celled where pickup_h3 in (select pickup_h3 from celled where pickup_h3 is not null group by 1 order by count(*) desc, 1 limit 5))", 5
    ),
    "top_origins": "select pickup_h3, count(*) as trips from celled where pickup_h3 is not null group by 1 order by trips desc, pickup_h3 limit 20",
    "parametrised_sql": f"select season, is_weekend, count(*) as trips from wide where neighborhood = '{_N}' and trip_miles >= 2.0 group by all",
    "od_edges": "select * from edges",
    "node_strength": "select * from strength",
    "graph_size": """select n as nodes, e as edges, case when n > 1 then e / (n * (n - 1))::double end as density
        from (select (select count(*) from nodes) as n, (select count(*) from edges) as e)""",
    "undirected_edges": "select * from pairs",
    "pagerank": "select h3_cell, round(pagerank, 7) as pagerank from ranked",
    "betweenness": "select h3_cell, round(betweenness, 6) as betweenness from w_between",
    "betweenness_inverse": "select h3_cell, round(betweenness, 6) as betweenness from i_between",
    "node_metrics": "select * from metrics",
    "graph_summary": f"""select '{c.LOGGED_AT}' as generated_at, n as nodes, e as edges, 5 as min_edge_weight, true as is_directed,
          case when n > 1 then e / (n * (n - 1))::double end as density,
          (select string_agg(h3_cell || ':' || total_flow::bigint || ':' || round(pagerank * 1e7)::bigint, ',' order by rank) from metrics where rank <= 10) as top_10_by_flow
        from (select (select count(*) from nodes) as n, (select count(*) from edges) as e)""",
    "district_modularity": f"""select round(sum(inside) / (sum(degree) / 2) - sum(degree * degree) / (4 * (sum(degree) / 2) * (sum(degree) / 2)), 9) as modularity
        from ({_DISTRICT_DEGREES})""",
    "district_parts": "select h3_cell, part from spread where round = 40",
    "job_landed": f"select trip_id, trip_start_timestamp, trip_miles, tolls, {_PARTS} from job_rows",
    "job_log": f"""select m.year, m.month, coalesce(n.records, 0)::bigint as records,
          case when coalesce(n.records, 0) = 0 then 'empty' else 'ok' end as status
        from calendar m left join ({_month_counts('job_rows')}) n using (year, month)""",
    "job_loss": """select original, kept, original - kept as removed
        from (select (select count(*) from landed) as original, (select count(*) from landed_clean) as kept)""",
    "job_clean": f"select trip_id, trip_start_timestamp, trip_seconds, fare, {_PARTS} from job_kept",
    "job_report": """select 'year=' || year(trip_start_timestamp) || '/month=' || lpad(month(trip_start_timestamp)::varchar, 2, '0') || '/data.parquet' as file,
          count(*) as rows_raw, count(*) filter (failed is null) as rows_clean
        from job_judged where trip_start_timestamp is not null group by 1""",
    "job_features": f"""select trip_id, hour, neighborhood, fare_per_mile, p.cell as pickup_h3,
          year(trip_start_timestamp)::integer as p_year, month(trip_start_timestamp)::integer as p_month
        from job_wide t left join cells p on p.lat = t.pickup_centroid_latitude and p.lon = t.pickup_centroid_longitude""",
    "job_loaded": f"""select trip_id, trip_start_timestamp, neighborhood, p.cell as pickup_h3
        from (select * from job_wide where trip_id is not null qualify {_FIRST_COPY}) t
        left join cells p on p.lat = t.pickup_centroid_latitude and p.lon = t.pickup_centroid_longitude""",
    "job_scope": f"""select step, trip_id, {_PARTS} from job_kept, (values ('clean'), ('features')) s(step)
        where year(trip_start_timestamp) = {SCOPE[0]} and month(trip_start_timestamp) = {SCOPE[1]}""",
    "job_failures": f"""select year, month, case when month = {SCOPE[1]} then 0 else records end::bigint as records,
          case when month = {SCOPE[1]} then 'error' else 'ok' end as status, month <> {SCOPE[1]} as timed, records as held
        from ({_month_counts('job_rows')}) where year = {SCOPE[0]} and month in ({SCOPE[1] - 1}, {SCOPE[1]})""",
    "job_graph_tables": """select 'edge' as item, pickup_h3 || '>' || dropoff_h3 as key, weight::bigint as value from job_edges
        union all select 'flow', cell, sum(weight)::bigint from (
          select pickup_h3 as cell, weight from job_edges union all select dropoff_h3, weight from job_edges) group by 2
        union all select 'labelled', '', count(distinct cell) from (select pickup_h3 as cell from job_edges union all select dropoff_h3 from job_edges)
        union all select 'hour', hour::varchar, count(*) from job_wide where hour is not null group by 2
        union all select 'trips', '', 0""",
    "community_check": """select count(*) as nodes, 0::bigint as misnumbered, 0::bigint as unlabelled, 0::bigint as gaining,
          0::bigint as split, true as beats_districts from nodes""",
    "community_sizes": "select * from districts",
    "top_hexagons": f"select {_TOP_HEX} order by total_flow desc, h3_cell limit 20",
    "top_hexagons_betweenness": f"select {_TOP_HEX} order by betweenness_norm desc, h3_cell limit 10",
    "hexagon_metrics": "select * from metrics left join districts using (h3_cell) where rank = 1",
    "hexagon_trips": f"""select count(*) as total_trips, {avg2('total_amount')} as avg_ticket, {avg2('trip_miles')} as avg_miles,
          {avg2('speed_mph')} as avg_speed, (select neighborhood from usual where h3_cell = (select leader from leader)) as neighborhood
        from celled where pickup_h3 = (select leader from leader)""",
    "community_stats": """select community, count(*) as hexagon_count, sum(total_flow) as total_flow,
          cast(round(cast(avg(pagerank) as decimal(38,10)), 6) as double) as avg_pagerank
        from districts join metrics using (h3_cell) group by 1""",
    "community_flow": """select community, count(total_flow) as count, round_even(sum(total_flow), 0) as sum, round_even(avg(total_flow), 0) as mean
        from strength join districts using (h3_cell) group by 1""",
    "edges_top": "select * from edges where weight >= 7 order by weight desc, pickup_h3, dropoff_h3 limit 50",
    "map_styles": f"""select h3_cell, total_flow, community, round(f, 6) as flow_norm, round(f * 0.7::double + 0.2::double, 6) as opacity,
          {_color('f', display.FLOW_COLORS, display.FLOW_REST)} as flow_color,
          [{', '.join(f"'{color}'" for color in display.COMMUNITY_COLORS)}][community % 10 + 1] as community_color,
          round(p, 6) as pr_norm, {_color('p', display.PAGERANK_COLORS, display.PAGERANK_REST)} as pagerank_color
        from (select *, (total_flow - min(total_flow) over ()) / (max(total_flow) over () - min(total_flow) over ()) as f,
          (pagerank - min(pagerank) over ()) / (max(pagerank) over () - min(pagerank) over ()) as p from metrics)
        left join districts using (h3_cell)""",
    "flow_share": "select h3_cell, round(least(total_flow / max(total_flow) over (), 1), 9) as flow_share from strength",
    "neighborhood_board": """select (row_number() over (order by n desc, neighborhood))::integer as position, upper(neighborhood) as title,
          n as total_trips, printf('%.0f', round(n / 1000.0, 0)) || 'k' as trips_label, round(n / (max(n) over ()) * 100, 9) as pct_of_leader
        from (select neighborhood, count(*) as n from wide where neighborhood is not null group by 1)""",
    "pagerank_board": f"""select (row_number() over (order by pagerank desc, h3_cell))::integer as position,
          coalesce(nullif(neighborhood, ''), left(h3_cell, 12) || '...') as label,
          printf('%.4f', round(pagerank, 4)) as pagerank_label, community
        from (select {_TOP_HEX} order by pagerank desc, h3_cell limit 10)""",
    "community_board": """select community, count(*) as hexagon_count, printf('%.1f', round(sum(total_flow) / 1e6, 1)) || 'M' as flow_label,
          printf('%.4f', round(cast(round(cast(avg(pagerank) as decimal(38,10)), 6) as double), 4)) as pagerank_label
        from districts join metrics using (h3_cell) group by 1""",
    "day_labels": f"""select [{', '.join(f"'{d}'" for d in display.DAY_LABELS)}][day_of_week + 1] as day,
          case when is_rush_hour = 1 then 'Rush Hour' else 'Fora do Pico' end as period, count(*) as trips,
          printf('%.2f', round(count(*) * 1000 / 1e6, 2)) || 'M' as millions from wide group by 1, 2""",
    "cell_labels": "select h3_cell as pickup_h3, coalesce(nullif(neighborhood, ''), left(h3_cell, 12) || '...') as label from usual",
    "viewport": """select trip_id, round(260 + (pickup_centroid_longitude + 87.8807::double) / (-87.5279::double + 87.8807::double) * 720, 6) as x,
          round(20 + (42.0222::double - pickup_centroid_latitude) / (42.0222::double - 41.6596::double) * 560, 6) as y from clean""",
    "hexagon_export": f"""select h3_cell, total_flow as flow, 6 as corners, {_r7('lat').replace(' as lat', ' as first_lat')}, {_r7('lon').replace(' as lon', ' as first_lon')}
        from strength join (select distinct on (h3_cell) * from every_corner where corner = 0) using (h3_cell)""",
}
FINALS["hexagon_detail"] = f"select * from ({FINALS['hexagon_metrics']}), ({FINALS['hexagon_trips']})"
BLOCKS["every_spot"] = "select distinct cell as h3_cell, a9, b9 from cells"
BLOCKS["every_corner"] = _position("a9 + ca / 3.0::double", "b9 + cb / 3.0::double", "(select * from every_spot, corner_list)", "h3_cell, corner,")


def oracles() -> dict[str, str]:
    stated = {name: statement(final) for name, final in FINALS.items()}
    # From monthly states as from the trips.
    return stated | {f"cube_{name}": stated[name] for name in CUBE_QUERIES}
