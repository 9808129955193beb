"""SQL counterparts of the queries on the same tables, written without the library's algorithms.

Point location is tested against the analytic shape of each tract, centroids against closed forms,
and published counts against the numbers they were printed from.
"""

from __future__ import annotations

from catalog.standins import TABLES


def title(expr: str) -> str:
    runs = rf"regexp_extract_all(lower({expr}), '(\p{{L}}+|[^\p{{L}}]+)')"
    return f"array_to_string(list_transform({runs}, lambda r: case when r[1] = 'ß' then 'Ss' else upper(r[1]) end || r[2:]), '')"


def paren(expr: str) -> str:
    return rf"nullif(upper(regexp_replace(regexp_extract({expr}, '\(([^)]+)\)', 1), '^\s+|\s+$', '', 'g')), '')"


def unparen(expr: str) -> str:
    bare = rf"regexp_replace({expr}, '\s*\([^)]+\)', '', 'g')"
    return (
        rf"case when regexp_matches({expr}, '\([^)]+\)') "
        rf"then regexp_replace({bare}, '^\s+|\s+$', '', 'g') else {expr} end"
    )


def share(count: str, total: str) -> str:
    return f"case when {total} > 0 then {count} / {total} else 0.0::double end"


def bounded_share(count: str, total: str) -> str:
    value = share(count, total)
    return (
        f"case when ({value}) is null then null when ({value}) < 1e-3 then 0.0::double "
        f"when ({value}) > 1 then 1.0::double else ({value}) end"
    )


def scaled(value: str, low: str, high: str) -> str:
    return (
        f"case when {high} is null then null::double "
        f"when {high} <> {low} then ({value} - {low}) / ({high} - {low}) * 100 else 0.0::double end"
    )


def mean_of(*values: str) -> str:
    total = " + ".join(f"coalesce({v}, 0)" for v in values)
    present = " + ".join(f"({v} is not null)::int" for v in values)
    return f"({total}) / nullif({present}, 0)::double"


def corner(k: str) -> tuple[str, str]:
    return (
        f"(-120.0::double + ({k} % 1000000) * 1e-4)",
        f"(-21.0::double + ({k} % 7) * 5 + ({k} // 1000000) * 1e-4)",
    )


X0, Y0 = corner("c_custkey")
POINT = f"""
select (c_custkey + 10000000)::varchar as facilityid, c_custkey,
  {X0} + ((c_custkey * 37) % 97 + 3e-1) / 97 * 1e-4 - case when c_custkey % 11 = 0 then 50 else 0 end as longitude,
  {Y0} + ((c_custkey * 53) % 89 + 3e-1) / 89 * 1e-4 as latitude
from customer"""

X0, Y0 = corner("p_partkey")
TRACT = f"select p_partkey, lpad((p_partkey + 6000000000)::varchar, 11, '0') as geoid, {X0} as x0, {Y0} as y0 from part"

# Position of a point within the square of a tract, 0 to 1 on both axes, against the three shapes.
WITHIN = """
u > 0 and u < 1 and v > 0 and v < 1 and case p_partkey % 3
  when 0 then u + v < 1
  when 1 then not (u > 25e-2 and u < 75e-2 and v > 25e-2 and v < 75e-2)
  else u < 4e-1 or u > 6e-1 end"""
LOCATED = f"""
select p.facilityid, t.geoid from point p join
  (select *, p_partkey as pk from tract) t
  on p.latitude > t.y0 and p.latitude < t.y0 + 1e-4 and p.longitude > t.x0 and p.longitude < t.x0 + 1e-4
where {WITHIN.replace('u ', '((p.longitude - t.x0) / 1e-4) ').replace('v ', '((p.latitude - t.y0) / 1e-4) ')}"""

BOUNDARY = """
select c_custkey, (c_custkey + 10000000)::varchar as facilityid,
  c_mktsegment || ' MEN''S STATE PRISON'
    || case when c_custkey % 4 = 0 then ' CAMPUS' else '' end
    || case when c_custkey % 5 <> 0 then ' ( s' || (c_custkey // 15) || ' )' else '' end
    || case when c_custkey % 3 = 0 then ' (WEST)' else '' end as name,
  c_nationkey || 'TH o''brien-road' as address,
  'city of ' || lower(c_mktsegment) as city,
  case when c_nationkey % 4 = 0 then 'NV' else 'CA' end as state,
  case when c_custkey % 10 = 9 then 'CLOSED' else 'OPEN' end as status,
  case c_custkey + 10000000
    when 10000850 then 'FEDERAL' when 10000851 then 'FEDERAL' when 10000849 then 'FEDERAL'
    when 10000845 then 'STATE' when 10000846 then 'STATE'
    else case c_custkey % 4 when 0 then 'LOCAL' when 1 then 'COUNTY' else 'STATE' end end as type,
  case when c_custkey % 9 = 0 then null else (100 + c_custkey % 900)::double end as population,
  case when c_custkey % 13 = 0 then null when c_custkey % 17 = 0 then 0.0::double
    else (200 + (c_custkey * 7) % 1000)::double end as capacity
from customer"""

AVERAGE = """
select 'S' || s_suppkey as code,
  case when s_suppkey % 19 = 0 then 0.0::double when s_suppkey % 23 = 0 then null
    else (1000 + (s_suppkey * 37) % 4000)::double end as average_2025_population
from supplier"""

FACTS = """
select 'S' || s_suppkey as code, (s_suppkey % 170 + 1850)::int as year_opened,
  case when s_suppkey % 4 = 0 then 'Opened as "' || s_name || '", later renamed' end as year_opened_notes,
  case when s_suppkey % 3 = 0 then 'Yes' end as reentry_hub,
  case when s_suppkey % 31 = 0 then 'Yes' end as planned_closure,
  case when s_suppkey % 5 = 0 then 'Yes' end as california_model_facility,
  case when s_suppkey % 8 = 0 then 'Yes' end as cdcr_air_cooling_pilot
from supplier"""

PEOPLE = """
case when l_orderkey % 11 = 0 then 0 when l_orderkey % 13 = 0 then 5 when l_orderkey % 17 = 0 then 25
  when l_orderkey % 19 = 0 then 0 else (l_orderkey * 31 + l_linenumber * 7) % 5000 end::double"""
BAND = "floor((l_quantity - 1) / 5)::int"
GENDER = "case when l_linestatus = 'F' then 'female' else 'male' end"
RACE = "case l_returnflag when 'A' then 'white' when 'N' then 'black' else 'hispanic_latino' end"
COUNTRY = "case o_orderkey % 4 when 0 then 'el_salvador' when 1 then 'guinea_bissau' when 2 then 'mexico' else 'us_canada' end"
BANDS = [f"{low}_{low + 4}_years" for low in range(45, 95, 5)]


def panel(category: str) -> str:
    return f"""select location, category, avg(people) as mean from
      (select 'S' || l_suppkey as location, {category} as category, {PEOPLE} as people from lineitem)
      group by location, category"""


COUNTRY_PANEL = f"""select location, category, avg(people) as mean from
  (select 'S' || (o_custkey // 10) as location, {COUNTRY} as category, (o_custkey % 500)::double as people from orders)
  group by location, category"""


def cell(category, name: str) -> str:
    literal = category if isinstance(category, int) else f"'{category}'"
    return f"coalesce(max(mean) filter (where category = {literal}), 0) as {name}"


AGE_WIDE = (
    "select location, "
    + ", ".join(cell(i, f"age_{b}") for i, b in enumerate(BANDS))
    + f" from ({panel(BAND)}) group by location"
)
GENDER_WIDE = f"select location, {cell('female', 'gender_female')}, {cell('male', 'gender_male')} from ({panel(GENDER)}) group by location"
RACE_WIDE = (
    "select location, "
    + ", ".join(cell(r, f"race_{r}") for r in ("black", "hispanic_latino", "white"))
    + f" from ({panel(RACE)}) group by location"
)
COUNTRY_WIDE = (
    "select location, "
    + ", ".join(cell(c, f"cob_{c}") for c in ("el_salvador", "guinea_bissau", "mexico", "us_canada"))
    + f" from ({COUNTRY_PANEL}) group by location"
)

CODED = f"""
select b.facilityid, b.cdcr_code, b.population, b.capacity, a.average_2025_population,
  a.average_2025_population / nullif(b.capacity, 0) as capacity_percent_2025
from (select *, {paren('name')} as cdcr_code from boundary) b left join average a on a.code = b.cdcr_code"""

_TIERS = {"50": 1, "55": 2, "60": 3, "65": 4}
_TIER_SUMS = ", ".join(
    f"{' + '.join(f'age_{b}' for b in BANDS[first:])} as over_{t}" for t, first in _TIERS.items()
)
TIERS = f"select location, {_TIER_SUMS} from age"

_DAYS = ", ".join(
    f"sum(l_quantity) filter (where l_quantity > {least} and year(l_shipdate) {test} 1998) as days_over_{t}_{when}"
    for t, least in ((80, 0), (90, 20), (100, 40))
    for when, test in (("historic", "<="), ("midcentury", ">"))
)
HEAT = f"select lpad((l_partkey + 6000000000)::varchar, 11, '0') as geoid, {_DAYS} from lineitem group by l_partkey"
SCREEN = """
select lpad((p_partkey + case when p_partkey % 10 = 9 then 7000000000 else 6000000000 end)::varchar, 11, '0') as tract,
  p_size * 2.0::double as PollutionP,
  case when p_partkey % 7 <> 0 then ((p_partkey * 13) % 101)::double end as ozoneP,
  case when p_partkey % 5 <> 0 then ((p_partkey * 29) % 101)::double end as pmP,
  case when p_partkey % 3 <> 0 and p_partkey % 35 <> 0 then ((p_partkey * 31) % 101)::double end as dieselP
from part"""
AIR = mean_of("ozoneP", "pmP", "dieselP")
HAZARD = f"""
first as (
  select h.*, s.PollutionP, {AIR} as aqi from heat h left join screen s on s.tract = h.geoid),
ends as (
  select min(aqi) as la, max(aqi) as ha, min(days_over_90_historic) as ld, max(days_over_90_historic) as hd from first),
parts as (
  select first.*, {scaled('aqi', 'la', 'ha')} as air_scaled, {scaled('days_over_90_historic', 'ld', 'hd')} as days_scaled
  from first, ends),
mixed as (select *, {mean_of('air_scaled', 'days_scaled')} as idx from parts),
outer_ends as (select min(idx) as li, max(idx) as hi from mixed),
hazard as (select mixed.*, {scaled('idx', 'li', 'hi')} as idx_scaled from mixed, outer_ends)"""
HAZARD_COLUMNS = """days_over_90_historic, days_over_90_midcentury,
  days_over_90_midcentury - days_over_90_historic as delta_90, PollutionP,
  air_scaled as "AQI_norm", idx_scaled as heat_hazard_idx_norm"""

_PARTS = {
    "point": POINT,
    "tract": TRACT,
    "boundary": BOUNDARY,
    "average": AVERAGE,
    "facts": FACTS,
    "age": AGE_WIDE,
    "gender": GENDER_WIDE,
    "race": RACE_WIDE,
    "country": COUNTRY_WIDE,
    "heat": HEAT,
    "screen": SCREEN,
}


def using(*names: str) -> str:
    return ", ".join(f"{n} as ({_PARTS[n]})" for n in names)


_R = "6378137.0::double"


def merc(lat: str) -> str:
    return f"ln(tan(pi() / 4 + radians({lat}) / 2)) * {_R}"


def unmerc(y: str) -> str:
    return f"degrees(2 * atan(exp(({y}) / {_R})) - pi() / 2)"


FACILITY = f"""
located as ({LOCATED}),
placed as (
  select b.facilityid, {title('b.name')} as name, {title('b.address')} as address, {title('b.city')} as city,
    b.type, b.population, b.capacity, b.population / nullif(b.capacity, 0) as capacity_percent,
    l.geoid as tract_geoid, round(p.longitude, 8) as longitude, round(p.latitude, 8) as latitude
  from boundary b join point p using (facilityid) left join located l using (facilityid)
  where b.state = 'CA' and b.status = 'OPEN')"""

_TIER_SHARES = ", ".join(
    f"{share(f't.over_{t}', 'f.average_2025_population')} as age_over_{t}_pct" for t in _TIERS
)
_GENDER_SHARES = ", ".join(
    f"{bounded_share(f'g.gender_{c}', 'f.average_2025_population')} as gender_{c}_pct"
    for c in ("female", "male")
)
_RACE_SHARES = (
    f"{share('r.race_white', 'f.average_2025_population')} as race_white_pct, "
    f"{share('(r.race_black + r.race_hispanic_latino)', 'f.average_2025_population')} as race_peopleofcolor_pct"
)

_SHARES = (
    *(f"age_over_{t}_pct" for t in _TIERS),
    "gender_female_pct", "gender_male_pct", "race_white_pct", "race_peopleofcolor_pct",
)


def fmt(value: str) -> str:
    return f"round({value}, 6)::varchar"


def ring(*corners: tuple[str, str]) -> str:
    return "'(' || " + " || ', ' || ".join(f"{fmt(x)} || ' ' || {fmt(y)}" for x, y in corners) + " || ')'"


def box_ring(x1: str, y1: str, x2: str, y2: str, clockwise: bool = False) -> str:
    corners = [(x1, y1), (x2, y1), (x2, y2), (x1, y2), (x1, y1)]
    return ring(*(reversed(corners) if clockwise else corners))


def _at(axis: str, part: str) -> str:
    return f"{axis}0" if part == "0" else f"{axis}0 + 1e-4 * {part}"


_FULL = box_ring("x0", "y0", "x0 + 1e-4", "y0 + 1e-4")
_HOLE = box_ring(_at("x", "25e-2"), _at("y", "25e-2"), _at("x", "75e-2"), _at("y", "75e-2"))
_WEST = box_ring("x0", "y0", _at("x", "4e-1"), "y0 + 1e-4")
_EAST = box_ring(_at("x", "6e-1"), "y0", "x0 + 1e-4", "y0 + 1e-4", clockwise=True)
_TRIANGLE = ring(("x0", "y0"), ("x0 + 1e-4", "y0"), ("x0", "y0 + 1e-4"), ("x0", "y0"))

STATE_FACILITY = f"""
boundary as (
  select facilityid, {title('name')} as name, {title('address')} as address, {title('city')} as city, population, capacity
  from ({BOUNDARY}) where state = 'CA' and status = 'OPEN' and type = 'STATE'),
coded as (
  select b.facilityid, {unparen('b.name')} as name, b.address, b.city, b.population, b.capacity,
    b.population / nullif(b.capacity, 0) as capacity_percent, b.code as cdcr_code,
    contains(upper(b.name), 'CAMP') as cdcr_firecamp, a.average_2025_population,
    a.average_2025_population / nullif(b.capacity, 0) as capacity_percent_2025
  from (select *, case when facilityid = '10000826' then 'ASP' else {paren('name')} end as code from boundary) b
  left join average a on a.code = b.code)"""
COUNTRY_NAMES = ("el_salvador", "guinea_bissau", "mexico", "us_canada")

LAYER = f"""
with {using('tract')}
select p_partkey, geoid as "GEOID", null::varchar as lacking,
  (case p_partkey % 3 when 2 then 2 else 1 end)::bigint as parts,
  (case p_partkey % 3 when 0 then 1 else 2 end)::bigint as rings,
  (case p_partkey % 3 when 0 then 4 else 10 end)::bigint as points,
  x0 as xmin, y0 as ymin, x0 + 1e-4 as xmax, y0 + 1e-4 as ymax
from tract"""
SCREENED = """
select (p_partkey + case when p_partkey % 10 = 9 then 7000000000 else 6000000000 end)::varchar as tract,
  p_size * 2.0::double as "PollutionP",
  case when p_partkey % 7 <> 0 then ((p_partkey * 13) % 101)::double end as "ozoneP",
  case when p_partkey % 5 <> 0 then ((p_partkey * 29) % 101)::double end as "pmP",
  case when p_partkey % 3 <> 0 and p_partkey % 35 <> 0 then ((p_partkey * 31) % 101)::double end as "dieselP"
from part"""

ORACLES: dict[str, str] = {
    "q01_filter_project": """
select o_orderkey, o_custkey, o_totalprice, o_totalprice * 2 as doubled
from orders where o_orderstatus = 'F' and o_orderpriority = '1-URGENT'""",
    "q02_state_filter_after_override": f"""
with {using('boundary')} select facilityid, type from boundary where type = 'STATE'""",
    "q03_title_case": f"select doc_id, {title('text')} as titled from documents",
    "q04_paren_code": f"""
with {using('boundary')}
select facilityid, {unparen('name')} as name,
  case when facilityid = '10000826' then 'ASP' else {paren('name')} end as cdcr_code,
  contains(name, 'CAMP') as cdcr_firecamp
from boundary""",
    "q04_paren_text": f"""
select page_id, {paren('html')} as code, {unparen('html')} as rest,
  contains(upper(html), 'SCRIPT') as has_script
from pages""",
    "q04_missing_names": f"""
with {using('boundary')}, named as (
  select case when facilityid = '10000001' then '10000826' else facilityid end as facilityid,
    case when facilityid::int % 3 = 0 or facilityid = '10000001' then null else name end as name
  from boundary where facilityid <> '10000826' or facilityid::int % 3 = 0)
select facilityid, {unparen('name')} as name,
  case when facilityid = '10000826' then 'ASP' else {paren('name')} end as cdcr_code,
  coalesce(contains(name, 'CAMP'), false) as cdcr_firecamp
from named""",
    "q05_zero_pad_key": """
select c_custkey,
  repeat('0', greatest(7 - length((c_custkey * 7919)::varchar), 0)) || (c_custkey * 7919) as padded,
  repeat('0', greatest(11 - length((c_custkey * 7919)::varchar), 0)) || (c_custkey * 7919) as padded_number,
  c_name as kept_whole
from customer""",
    "q05_trimmed_text": r"""
select conv_id, turn, regexp_replace(role || ' ' || text, '^\s+|\s+$', '', 'g') as trimmed from conversations""",
    "q06_sentinel_to_null": f"""
with {using('boundary')}
select facilityid, population, capacity, population / nullif(capacity, 0) as capacity_percent from boundary""",
    "q06_column_guards": f"""
with {using('boundary')} select facilityid, population, 0.0::double as share from boundary""",
    "q07_suppressed_counts": f"select l_orderkey, l_linenumber, {PEOPLE} as population from lineitem",
    "q08_plain_ratio": """
select l_orderkey, l_linenumber, l_tax / nullif(l_discount, 0) as tax_per_discount,
  nullif(l_discount, 5e-2) / nullif(l_quantity, 0) as discount_per_unit
from lineitem""",
    "q09_override_map": """
select o_orderkey, (o_custkey + 10000000)::varchar as key,
  case when o_custkey in (849, 850, 851) then 'FEDERAL' when o_custkey in (845, 846) then 'STATE'
    else o_orderpriority end as o_orderpriority
from orders""",
    "q09_schema_operators": """
select p_partkey, 1 as age_old, p_partkey as race_other, null::varchar as code, false as flag from part""",
    "q10_clipped_floored_share": f"""
with {using('boundary', 'average', 'gender')}, coded as ({CODED})
select f.facilityid, f.cdcr_code, f.average_2025_population, {_GENDER_SHARES}
from coded f left join gender g on g.location = f.cdcr_code""",
    "q10_small_shares": """
with counted as (
  select c_custkey,
    case when c_custkey % 11 = 0 then null when c_custkey % 7 = 0 then 9000.0::double
      when c_custkey % 5 = 0 then -3.0::double else (c_custkey % 4)::double end as people,
    case when c_custkey % 13 = 0 then null when c_custkey % 17 = 0 then 0.0::double
      else (1000 + (c_custkey * 100) % 3000)::double end as population
  from customer)
select c_custkey, population,
  case when population is null or population <= 0 then 0.0::double when people is null then null
    when people / population < 1e-3 then 0.0::double when people > population then 1.0::double
    else people / population end as share
from counted""",
    "q11_lookup_enrich": f"""
with {using('boundary', 'average')}, coded as ({CODED})
select facilityid, cdcr_code, capacity, average_2025_population, capacity_percent_2025 from coded""",
    "q12_metadata_enrich": f"""
with {using('boundary', 'facts')}
select b.facilityid, b.cdcr_code, f.* exclude (code)
from (select facilityid, {paren('name')} as cdcr_code from boundary) b left join facts f on f.code = b.cdcr_code""",
    "q13_mean_pivot": f"with {using('race')} select location as \"Location\", race.* exclude (location) from race",
    "q13_category_means": f"""
select location as "Location",
  [{', '.join(f"'{low}-{low + 4} Years'" for low in range(45, 95, 5))}][category + 1] as age_group,
  mean as mean_count
from ({panel(BAND)})""",
    "q14_align_families": f"""
with {using('age', 'country', 'gender', 'race')}
select coalesce(age.location, country.location) as "Location",
  {', '.join(f'coalesce(age_{b}, 0) as age_{b}' for b in BANDS)},
  {', '.join(f'coalesce(cob_{c}, 0) as cob_{c}' for c in ('el_salvador', 'guinea_bissau', 'mexico', 'us_canada'))},
  coalesce(gender_female, 0) as gender_female, coalesce(gender_male, 0) as gender_male,
  {', '.join(f'coalesce(race_{r}, 0) as race_{r}' for r in ('black', 'hispanic_latino', 'white'))}
from age full join country on country.location = age.location
  left join gender on gender.location = age.location left join race on race.location = age.location""",
    "q15_cumulative_tiers": f"""
with {using('boundary', 'average', 'age')}, coded as ({CODED}), tiers as ({TIERS})
select f.facilityid, f.cdcr_code, f.average_2025_population, {_TIER_SHARES}
from coded f left join tiers t on t.location = f.cdcr_code""",
    "q16_one_vs_rest": f"""
with {using('boundary', 'average', 'race')}, coded as ({CODED})
select f.facilityid, f.cdcr_code, f.average_2025_population, {_RACE_SHARES}
from coded f left join race r on r.location = f.cdcr_code""",
    "q17_deltas": f"""
with {using('heat')}
select geoid as "GEOID", {', '.join(f'days_over_{t}_midcentury - days_over_{t}_historic as delta_{t}' for t in (80, 90, 100))}
from heat""",
    "q17_population_difference": f"""
with {using('boundary', 'average')}, coded as ({CODED})
select facilityid, population - average_2025_population as pop_diff from coded""",
    "q18_min_max": f"""
with ends as (select min(l_extendedprice) as lp, max(l_extendedprice) as hp, min(l_quantity) as lq, max(l_quantity) as hq from lineitem)
select l_orderkey, l_linenumber, l_extendedprice, l_quantity,
  {scaled('l_extendedprice', 'lp', 'hp')} as l_extendedprice_norm, {scaled('l_quantity', 'lq', 'hq')} as l_quantity_norm
from lineitem, ends""",
    "q19_min_max_constant_and_null": f"""
with built as (
  select c_custkey, case when c_custkey % 3 <> 0 then 7.0::double end as constant, null::double as absent,
    case when c_acctbal > 0 then c_acctbal end as gaps from customer),
ends as (select min(gaps) as lg, max(gaps) as hg from built)
select built.*, 0.0::double as constant_norm, null::double as absent_norm, {scaled('gaps', 'lg', 'hg')} as gaps_norm
from built, ends""",
    "q20_row_mean": f"""
with s as (
  select p_partkey + case when p_partkey % 10 = 9 then 7000000000 else 6000000000 end as tract,
    case when p_partkey % 7 <> 0 then ((p_partkey * 13) % 101)::double end as ozoneP,
    case when p_partkey % 5 <> 0 then ((p_partkey * 29) % 101)::double end as pmP,
    case when p_partkey % 3 <> 0 and p_partkey % 35 <> 0 then ((p_partkey * 31) % 101)::double end as dieselP
  from part)
select tract, {AIR} as mean_air, coalesce(ozoneP, 0) + coalesce(pmP, 0) + coalesce(dieselP, 0) as sum_air from s""",
    "q21_composite_index": f"""
with {using('heat', 'screen')}, {HAZARD}
select geoid as "GEOID", aqi as "AQI", air_scaled as "AQI_norm", days_scaled as days_over_90_historic_norm,
  idx as heat_hazard_idx, idx_scaled as heat_hazard_idx_norm
from hazard""",
    "q22_mercator": f"""
with {using('point')}
select facilityid, round(radians(longitude) * {_R}, 3) as x, round({merc('latitude')}, 3) as y,
  round(longitude, 8) as longitude, round(latitude, 8) as latitude
from point""",
    "q23_centroid": f"""
with {using('tract')}, centre as (
  select geoid, x0 + case p_partkey % 3 when 0 then 1e-4 / 3 else 5e-5 end as x,
    y0 + case p_partkey % 3 when 0 then 1e-4 / 3 else 5e-5 end as y from tract)
select geoid as "GEOID", round(x, 8) as x, round(y, 8) as y, round(x, 7) as longitude from centre""",
    "q23_hole_centroid": f"""
with {using('tract')}
select geoid as "GEOID", round(x0 + 1e-4 * (5e-1 - 8e-2 * 2e-1) / 92e-2, 8) as x,
  round(y0 + 1e-4 * (5e-1 - 8e-2 * 4e-1) / 92e-2, 8) as y
from tract""",
    "q23_footprint_centre": f"""
with {using('point')}
select facilityid, round(longitude, 8) as longitude,
  round({unmerc(f"({merc('(latitude - 2e-6)')} + {merc('(latitude + 2e-6)')}) / 2")}, 8) as latitude
from point""",
    "q24_point_in_polygon": f"""
with {using('point', 'tract')}, located as ({LOCATED})
select facilityid, l.geoid as "GEOID" from point left join located l using (facilityid)""",
    "q24_parquet_layer": f"""
with {using('point', 'tract')}, located as ({LOCATED})
select facilityid, l.geoid as "GEOID" from point left join located l using (facilityid)""",
    "q24_points_on_borders": f"""
with {using('point', 'tract')}, located as ({LOCATED})
select facilityid, 'point' as place, l.geoid as "GEOID" from point left join located l using (facilityid)
union all
select facilityid, place, null from point, (
  select unnest(['corner', 'bottom', 'left', 'top_left', 'bottom_right', 'hole_corner', 'hole_edge']) as place)""",
    "q25_lookup_back": f"""
with {using('point', 'tract')}
select p.facilityid, min(t.geoid) as tract_geoid
from point p left join tract t on p.longitude > t.x0 and p.longitude < t.x0 + 75e-5
  and p.latitude > t.y0 and p.latitude < t.y0 + 1e-4
group by p.facilityid""",
    "q26_wkt": f"""
with {using('tract')}
select geoid as "GEOID", 'MULTIPOLYGON (' || case p_partkey % 3
  when 0 then '(' || {_TRIANGLE} || ')'
  when 1 then '(' || {_FULL} || ', ' || {_HOLE} || ')'
  else '(' || {_WEST} || '), (' || {_EAST} || ')' end || ')' as wkt
from tract""",
    "q27_attach_hazards": f"""
with {using('heat')}, located as (
  select (c_custkey + 10000000)::varchar as facilityid, lpad((c_custkey * 3 + 6000000000)::varchar, 11, '0') as tract_geoid
  from customer)
select l.facilityid, l.tract_geoid, h.* exclude (geoid) from located l left join heat h on h.geoid = l.tract_geoid""",
    "q28_describe": """
select count(l_extendedprice) as count, round(avg(l_extendedprice), 4) as mean, round(stddev_samp(l_extendedprice), 4) as std,
  round(min(l_extendedprice), 4) as min, round(quantile_cont(l_extendedprice, 0.25), 4) as p25,
  round(quantile_cont(l_extendedprice, 0.5), 4) as p50, round(quantile_cont(l_extendedprice, 0.75), 4) as p75,
  round(max(l_extendedprice), 4) as max
from lineitem""",
    "q29_value_counts": """
select event_type, count(*) as count from events where event_type <> 'error' group by event_type
order by count desc, event_type""",
    "q30_row_counts": " union all ".join(
        f"select '{t}' as table_name, count(*) as rows from {t}" for t in TABLES
    ),
    "q31_csv_roundtrip": """
select doc_id, lang, 'said "' || source || '",' || chr(13) || chr(10) || 'and left' as note, text,
  n_chars / 7::double as measure, doc_id % 2 = 0 as even
from documents""",
    "q31_panel_csv_scan": f"""
select 'S' || l_suppkey as "Location", case when l_linestatus = 'F' then 'Female' else 'Male' end as "Gender",
  count(*) filter (where l_orderkey % 19 <> 0 or l_orderkey % 11 = 0 or l_orderkey % 13 = 0 or l_orderkey % 17 = 0) as shown,
  sum({PEOPLE}) as people
from lineitem group by all""",
    "q31_hazard_csv": f"""
with {using('heat', 'screen')}, {HAZARD} select geoid, {HAZARD_COLUMNS} from hazard""",
    "q31_csv_quarantine": """
with bad as (
  select case when l_orderkey % 37 = 0 then l_quantity::varchar || ',x,' || l_linenumber || ',' || l_orderkey || ',more'
      when l_orderkey % 41 = 0 then l_quantity::varchar || ',x,' || l_linenumber
      else 'dozen,"a, b",' || l_linenumber || ',' || l_orderkey end as record,
    case when l_orderkey % 37 = 0 or l_orderkey % 41 = 0 then 'wrong number of cells'
      else 'not double in l_quantity: dozen' end as problem
  from lineitem where l_orderkey % 37 = 0 or l_orderkey % 41 = 0 or l_orderkey % 43 = 0)
select l_orderkey, l_linenumber, case when l_orderkey % 47 <> 0 then l_quantity end as l_quantity,
  1::bigint as rows, null::varchar as record, null::varchar as problem
from lineitem where l_orderkey % 37 <> 0 and l_orderkey % 41 <> 0 and l_orderkey % 43 <> 0
union all select null, null, null, count(*), record, problem from bad group by record, problem""",
    "q32_geojson_scan": LAYER,
    "q32_geojson_collection": LAYER,
    "q32_geojson_attributes": SCREENED,
    "q33_facility_table": f"with {using('point', 'tract', 'boundary')}, {FACILITY} select * from placed",
    "q34_state_facility_table": f"""
with {using('average', 'facts', 'age', 'gender', 'race')}, tiers as ({TIERS}),
{STATE_FACILITY}
select joined.* replace ({', '.join(f'round({c}, 9) as {c}' for c in _SHARES)}) from (
select f.*, {_TIER_SHARES}, {_GENDER_SHARES}, {_RACE_SHARES}, m.* exclude (code)
from coded f left join tiers t on t.location = f.cdcr_code left join gender g on g.location = f.cdcr_code
  left join race r on r.location = f.cdcr_code left join facts m on m.code = f.cdcr_code) joined""",
    "q34_birth_country_shares": f"""
with {using('average', 'facts', 'country', 'gender')}, {STATE_FACILITY}
select f.facilityid, f.cdcr_code, f.average_2025_population,
  {', '.join(f"round({share(f'g.gender_{c}', 'f.average_2025_population')}, 9) as gender_{c}_pct" for c in ('female', 'male'))},
  {', '.join(f"round({bounded_share(f'coalesce(c.cob_{c}, g.gender_male * 0)', 'f.average_2025_population')}, 9) as cob_{c}_pct" for c in COUNTRY_NAMES)}
from coded f left join gender g on g.location = f.cdcr_code left join country c on c.location = f.cdcr_code""",
    "q34_share_maps": f"""
with {using('average', 'facts')}, {STATE_FACILITY}, means as (
  select location, 'cob_' || category as category, mean from ({COUNTRY_PANEL})
  union all select location, 'gender_' || category, mean from ({panel(GENDER)}))
select f.facilityid, m.category, round({bounded_share('m.mean', 'f.average_2025_population')}, 9) as share
from coded f join means m on m.location = f.cdcr_code""",
    "q35_heat_air_hazard_table": f"""
with {using('heat', 'screen')}, {HAZARD} select geoid, {HAZARD_COLUMNS} from hazard""",
    "q36_exposure_table": f"""
with {using('point', 'tract', 'boundary', 'heat', 'screen')}, {FACILITY}, {HAZARD}
select p.* exclude (address, city), h.* exclude (geoid)
from placed p left join (select geoid, {HAZARD_COLUMNS} from hazard) h on h.geoid = p.tract_geoid""",
}
