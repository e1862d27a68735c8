"""Registered queries (Spark) and their DuckDB oracle SQL, keyed by name.

Every query reads the test tables of ``sf_dir`` in full; the time range
covers the whole month of data.  Computed doubles are rounded to 6 digits on
both sides so the comparison is immune to summation order.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagscope.operators import pointintime as pit
from tagscope.plans.derived import derived
from tagscope.session import shared_dir
from tagscope.sources import testdata as td
from tagscope.streaming import dimension as dim

# Parameters of the registered queries.
FROM = "2024-01-01 00:00:00"
TO = "2024-02-01 00:00:00"
AT = "2024-01-10 00:00:00"
AT_LATE = "2024-01-31 12:00:00"   # after the last loaded sample: the guard bites
N_INSTANTS = 300                  # points asked by the reference's data page
DIGITS = 6


def r6(c):
    return F.round(c, DIGITS)


QUERIES: dict = {}
ORACLE: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ---- DuckDB views (same definitions as tagscope.sources.testdata) ----------
V_HISTORY = ("history as (select concat('A20_WT_', lpad(cast(user_id % 20 as varchar), 2, '0')) as TagName, "
             "ts as DateTime, cast(value as double) as Value from events)")
V_STATE = ("state_history as (select cast(user_id as varchar) as TagName, ts as DateTime, "
           "case when event_type = 'error' then 0.0 else 1.0 end as Value from events)")
V_COUNTER = ("counter_history as (select TagName, DateTime, round(sum(Value) over (partition by TagName "
             "order by DateTime rows between unbounded preceding and current row), 2) as Value from history)")


def ts(s: str) -> str:
    return f"timestamp '{s}'"


# ---- point in time ----------------------------------------------------------
@register("value_at_date", f"""
with {V_HISTORY}
select TagName, max(DateTime) as DateTime, arg_max(Value, DateTime) as Value
from history where DateTime <= {ts(AT)} group by TagName""")
def q_value_at_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = derived(spark, sf_dir)
    return pit.value_at(d.history, AT, tree=d.tree)


@register("value_at_date_guarded", f"""
with {V_HISTORY}, mark as (select max(DateTime) as m from history)
select TagName, max(DateTime) as DateTime,
       case when {ts(AT_LATE)} > (select m from mark) then null else arg_max(Value, DateTime) end as Value
from history where DateTime <= {ts(AT_LATE)} group by TagName""")
def q_value_at_date_guarded(spark, sf_dir):
    d = derived(spark, sf_dir)
    return pit.value_at(d.history, AT_LATE, guard=True, mark=dim.load_mark(d.dimension), tree=d.tree)


@register("value_at_date_interp", f"""
with {V_HISTORY},
b as (select TagName, max(DateTime) as bt, arg_max(Value, DateTime) as bv from history where DateTime <= {ts(AT)} group by TagName),
a as (select TagName, min(DateTime) as at_, arg_min(Value, DateTime) as av from history where DateTime >= {ts(AT)} group by TagName)
select b.TagName, {ts(AT)} as DateTime,
  round(case when epoch_us(a.at_) = epoch_us(b.bt) then bv
       else bv + (epoch_us({ts(AT)}) - epoch_us(b.bt))::double / (epoch_us(a.at_) - epoch_us(b.bt))::double * (av - bv) end, {DIGITS}) as Value
from b join a on a.TagName = b.TagName""")
def q_value_at_date_interp(spark, sf_dir):
    d = derived(spark, sf_dir)
    v = pit.value_interpolated(d.history, AT, tree=d.tree)
    return v.select("TagName", "DateTime", r6(F.col("Value")).alias("Value"))


@register("values_n_instants", f"""
with {V_HISTORY},
tg as (select distinct TagName from history
       where DateTime <= {ts(FROM)} + to_seconds(({N_INSTANTS} - 1) * (epoch({ts(TO)}) - epoch({ts(FROM)}))::bigint // {N_INSTANTS})),
inst as (select TagName, {ts(FROM)} + to_seconds((i * (epoch({ts(TO)}) - epoch({ts(FROM)}))::bigint) // {N_INSTANTS}) as DateTime
         from tg, range(0, {N_INSTANTS}) r(i))
select inst.TagName, inst.DateTime, h.Value
from inst asof left join history h on h.TagName = inst.TagName and h.DateTime <= inst.DateTime""")
def q_values_n_instants(spark, sf_dir):
    d = derived(spark, sf_dir)
    return pit.values_at_instants(d.history, FROM, TO, N_INSTANTS, tree=d.tree)


# ---- shared oracle fragments ------------------------------------------------
STEP = 60                     # resample step (s) of the registered range queries
CYCLIC_MS = 60000             # historian cyclic resolution
DIF_FROM = "2024-01-05 06:00:00"
DIF_TO = "2024-01-25 18:00:00"
N_BUCKETS = 300
N_DAYS = 31
N_FEW = 7

from tagscope.functions.timecols import epoch_us_value, seconds_between  # noqa: E402
from tagscope.operators import aggregate as agg  # noqa: E402
from tagscope.operators import buckets as bk  # noqa: E402
from tagscope.operators import resample as rs  # noqa: E402

T_SEC = seconds_between(FROM, TO)
K_CYC = -(-(T_SEC * 1000) // CYCLIC_MS)


def rounded(df: DataFrame, col: str = "Value") -> DataFrame:
    return df.select(*[r6(F.col(c)).alias(c) if c == col else F.col(c) for c in df.columns])


def seeded_union_sql(src: str, a: str, b: str) -> str:
    return (f"select TagName, DateTime, Value from {src} where DateTime between {ts(a)} and {ts(b)} "
            f"union all select TagName, {ts(a)}, arg_max(Value, DateTime) from {src} where DateTime <= {ts(a)} group by TagName "
            f"union all select TagName, {ts(b)}, arg_max(Value, DateTime) from {src} where DateTime <= {ts(b)} group by TagName")


def runs_sql(rows: str, step_s: int, keys: str = "TagName") -> str:
    """Present slots (mean per step) with the length until the next present slot."""
    us = step_s * 1_000_000
    return (f"select {keys}, slot, v, coalesce(lead(slot) over (partition by {keys} order by slot), slot + 1) as nxt "
            f"from (select {keys}, floor(epoch_us(DateTime) / {us})::bigint as slot, avg(Value) as v "
            f"from ({rows}) group by all)")


def buckets_sql(n: int) -> str:
    return (f"select i, {ts(FROM)} + to_seconds(((i - 1) * {T_SEC}) // {n}) as lo, "
            f"{ts(FROM)} + to_seconds((i * {T_SEC}) // {n}) as hi from range(1, {n} + 1) r(i)")


# ---- range retrieval (RNG1-4) -------------------------------------------------
@register("range_raw", f"""
with {V_HISTORY}
select TagName, DateTime, Value from history where DateTime >= {ts(FROM)} and DateTime < {ts(TO)}""")
def q_range_raw(spark, sf_dir):
    return rs.range_raw(td.history(spark, sf_dir), FROM, TO)


@register("range_resampled_seeded", f"""
with {V_HISTORY}, r as ({runs_sql(seeded_union_sql('history', FROM, TO), STEP)})
select TagName, make_timestamp(s * {STEP * 1_000_000}) as DateTime, round(v, {DIGITS}) as Value
from (select TagName, v, unnest(generate_series(slot, nxt - 1)) as s from r)""")
def q_range_resampled_seeded(spark, sf_dir):
    d = derived(spark, sf_dir)
    return rounded(rs.resample(d.history, FROM, TO, step_seconds=STEP, seeded=True, tree=d.tree))


@register("range_gapfill", f"""
with {V_HISTORY}, r as ({runs_sql(f"select * from history where DateTime between {ts(FROM)} and {ts(TO)}", STEP)})
select TagName, make_timestamp(s * {STEP * 1_000_000}) as DateTime, round(v, {DIGITS}) as Value
from (select TagName, v, unnest(generate_series(slot, nxt - 1)) as s from r)""")
def q_range_gapfill(spark, sf_dir):
    return rounded(rs.resample(td.history(spark, sf_dir), FROM, TO, step_seconds=STEP, seeded=False))


CYCLIC_INSTANTS = f"""
inst as (select TagName, {ts(FROM)} + to_microseconds(k::bigint * {CYCLIC_MS * 1000}) as DateTime
         from (select distinct TagName from history
               where DateTime <= {ts(FROM)} + to_microseconds(({K_CYC} - 1)::bigint * {CYCLIC_MS * 1000})), range(0, {K_CYC}) r(k)),
cyc as (select i.TagName, i.DateTime, h.Value from inst i asof join history h
        on h.TagName = i.TagName and h.DateTime <= i.DateTime)"""


@register("range_cyclic", f"""
with {V_HISTORY}, {CYCLIC_INSTANTS}
select TagName, DateTime, Value from cyc""")
def q_range_cyclic(spark, sf_dir):
    d = derived(spark, sf_dir)
    return pit.values_cyclic(d.history, FROM, TO, CYCLIC_MS, tree=d.tree)


# ---- grouped values (AGG1-9) ----------------------------------------------------
for _g in ("avg", "sum", "min", "max"):
    def _mk(g):
        def q(spark, sf_dir):
            return rounded(agg.aggregate(td.history(spark, sf_dir), FROM, TO, g, mode="raw"))
        return q
    register(f"group_{_g}", f"""
with {V_HISTORY}
select TagName, {ts(TO)} as DateTime, round({_g}(Value), {DIGITS}) as Value
from history where DateTime >= {ts(FROM)} and DateTime < {ts(TO)} group by TagName""")(_mk(_g))


@register("group_count", f"""
with {V_HISTORY}
select TagName, {ts(TO)} as DateTime, cast(count(Value) as double) as Value
from history where DateTime >= {ts(FROM)} and DateTime < {ts(TO)} group by TagName""")
def q_group_count(spark, sf_dir):
    return agg.aggregate(td.history(spark, sf_dir), FROM, TO, "count", mode="raw")


def _weighted_sql(rows: str, step: int = 1) -> str:
    return (f"with {V_HISTORY}, r as ({runs_sql(rows, step)}) "
            f"select TagName, {ts(TO)} as DateTime, round(sum(v * (nxt - slot)) / sum(nxt - slot), {DIGITS}) as Value "
            f"from r group by TagName")


@register("group_filled", _weighted_sql(f"select * from history where DateTime between {ts(FROM)} and {ts(TO)}"))
def q_group_filled(spark, sf_dir):
    return rounded(agg.aggregate(td.history(spark, sf_dir), FROM, TO, "avg", mode="filled"))


@register("group_filled_seeded", _weighted_sql(seeded_union_sql("history", FROM, TO)))
def q_group_filled_seeded(spark, sf_dir):
    d = derived(spark, sf_dir)
    return rounded(agg.aggregate(d.history, FROM, TO, "avg", mode="seeded", tree=d.tree))


@register("group_avgm", f"""
with {V_HISTORY}, r as ({runs_sql(seeded_union_sql("history", FROM, TO), 1)}),
points as (select TagName, v, unnest(generate_series(slot, nxt - 1)) as second from r)
select TagName, {ts(TO)} as DateTime, round(avg(v), {DIGITS}) as Value from points group by TagName""")
def q_group_avgm(spark, sf_dir):
    d = derived(spark, sf_dir)
    return rounded(agg.aggregate(d.history, FROM, TO, "avgm", mode="filled", tree=d.tree))


@register("group_cyclic", f"""
with {V_HISTORY}, {CYCLIC_INSTANTS}
select TagName, {ts(TO)} as DateTime, round(avg(Value), {DIGITS}) as Value from cyc group by TagName""")
def q_group_cyclic(spark, sf_dir):
    d = derived(spark, sf_dir)
    return rounded(agg.aggregate(d.history, FROM, TO, "avg", mode="cyclic", tree=d.tree))


@register("group_hours", f"""
with {V_HISTORY}, {CYCLIC_INSTANTS}
select TagName, {ts(TO)} as DateTime, round(count(Value) / 60.0, {DIGITS}) as Value from cyc group by TagName""")
def q_group_hours(spark, sf_dir):
    d = derived(spark, sf_dir)
    return rounded(agg.aggregate(d.history, FROM, TO, "count", mode="cyclic", tree=d.tree))


@register("group_dif", f"""
with {V_HISTORY}, {V_COUNTER},
f as (select TagName, arg_max(Value, DateTime) as v from counter_history where DateTime <= {ts(DIF_FROM)} group by TagName),
t as (select TagName, arg_max(Value, DateTime) as v from counter_history where DateTime <= {ts(DIF_TO)} group by TagName)
select t.TagName, {ts(DIF_TO)} as DateTime, round(t.v - f.v, {DIGITS}) as Value from t left join f on f.TagName = t.TagName""")
def q_group_dif(spark, sf_dir):
    d = derived(spark, sf_dir, "counter")
    return rounded(agg.aggregate(d.history, DIF_FROM, DIF_TO, "dif", mode="filled", tree=d.tree))


def _interp_sql(src: str, at: str, name: str) -> str:
    return (f"{name} as (select b.TagName, case when epoch_us(a.at_) = epoch_us(b.bt) then bv else bv + "
            f"(epoch_us({ts(at)}) - epoch_us(b.bt))::double / (epoch_us(a.at_) - epoch_us(b.bt))::double * (av - bv) end as v "
            f"from (select TagName, max(DateTime) as bt, arg_max(Value, DateTime) as bv from {src} where DateTime <= {ts(at)} group by TagName) b "
            f"join (select TagName, min(DateTime) as at_, arg_min(Value, DateTime) as av from {src} where DateTime >= {ts(at)} group by TagName) a "
            f"on a.TagName = b.TagName)")


@register("group_dif_interp", f"""
with {V_HISTORY}, {V_COUNTER}, {_interp_sql('counter_history', DIF_FROM, 'f')}, {_interp_sql('counter_history', DIF_TO, 't')},
tg as (select distinct TagName from counter_history)
select tg.TagName, {ts(DIF_TO)} as DateTime, round(t.v - f.v, {DIGITS}) as Value
from tg left join t on t.TagName = tg.TagName left join f on f.TagName = tg.TagName""")
def q_group_dif_interp(spark, sf_dir):
    d = derived(spark, sf_dir, "counter")
    return rounded(agg.aggregate(d.history, DIF_FROM, DIF_TO, "dif", mode="raw", tree=d.tree))


@register("totals", f"""
with {V_HISTORY}
select count(distinct TagName) as tags, count(*) as records from history""")
def q_totals(spark, sf_dir):
    return dim.totals(derived(spark, sf_dir).dimension)


# ---- N buckets (AGG10-11) -------------------------------------------------------
@register("buckets_raw", f"""
with {V_HISTORY}, b as ({buckets_sql(N_BUCKETS)}),
tg as (select distinct TagName from history where DateTime >= {ts(FROM)} and DateTime < {ts(TO)}),
a as (select h.TagName, b.i, avg(h.Value) as v from history h join b on h.DateTime >= b.lo and h.DateTime < b.hi group by all)
select tg.TagName, b.hi as DateTime, round(a.v, {DIGITS}) as Value
from tg cross join b left join a on a.TagName = tg.TagName and a.i = b.i""")
def q_buckets_raw(spark, sf_dir):
    return rounded(bk.buckets(td.history(spark, sf_dir), FROM, TO, N_BUCKETS, "avg", mode="raw"))


@register("buckets_count", f"""
with {V_STATE}, b as ({buckets_sql(N_FEW)}),
tg as (select distinct TagName from state_history where DateTime between {ts(FROM)} and {ts(TO)}),
a as (select h.TagName, b.i, count(h.Value) as v from state_history h join b on h.DateTime between b.lo and b.hi group by all)
select tg.TagName, b.hi as DateTime, cast(coalesce(a.v, 0) as double) as Value
from tg cross join b left join a on a.TagName = tg.TagName and a.i = b.i""")
def q_buckets_count(spark, sf_dir):
    return bk.buckets(td.state_history(spark, sf_dir), FROM, TO, N_FEW, "count", mode="closed_raw")


@register("buckets_filled", f"""
with {V_HISTORY}, b as ({buckets_sql(N_DAYS)}),
tg as (select distinct TagName from history where DateTime between {ts(FROM)} and {ts(TO)}),
x as (select h.TagName, b.i, h.DateTime, h.Value from history h join b on h.DateTime between b.lo and b.hi),
r as ({runs_sql('select * from x', 1, 'TagName, i')}),
a as (select TagName, i, sum(v * (nxt - slot)) / sum(nxt - slot) as v from r group by all)
select tg.TagName, b.hi as DateTime, round(a.v, {DIGITS}) as Value
from tg cross join b left join a on a.TagName = tg.TagName and a.i = b.i""")
def q_buckets_filled(spark, sf_dir):
    return rounded(bk.buckets(td.history(spark, sf_dir), FROM, TO, N_DAYS, "avg", mode="filled"))


@register("buckets_avgm", f"""
with {V_HISTORY}, b as ({buckets_sql(N_FEW)}),
r as ({runs_sql(seeded_union_sql('history', FROM, TO), 1)}),
rr as (select TagName, v, slot - {epoch_us_value(FROM) // 1_000_000} as ys, nxt - 1 - {epoch_us_value(FROM) // 1_000_000} as ye from r),
bb as (select i, ((i - 1) * {T_SEC}) // {N_FEW} as a, (i * {T_SEC}) // {N_FEW} as b, hi from ({buckets_sql(N_FEW)})),
x as (select rr.TagName, bb.i, rr.v, least(rr.ye, bb.b - 1) - greatest(rr.ys, bb.a + 1) + 1 as w
      from rr join bb on rr.ys <= bb.b - 1 and rr.ye >= bb.a + 1),
a as (select TagName, i, sum(v * w) / sum(w) as v from x where w > 0 group by all),
tg as (select distinct TagName from r)
select tg.TagName, bb.hi as DateTime, round(a.v, {DIGITS}) as Value
from tg cross join bb left join a on a.TagName = tg.TagName and a.i = bb.i""")
def q_buckets_avgm(spark, sf_dir):
    d = derived(spark, sf_dir)
    return rounded(bk.buckets(d.history, FROM, TO, N_FEW, "avgm", tree=d.tree))


@register("buckets_dif", f"""
with {V_HISTORY}, {V_COUNTER},
tg as (select distinct TagName from counter_history where DateTime <= {ts(TO)}),
e as (select tg.TagName, j, {ts(FROM)} + to_seconds((j * {T_SEC}) // {N_DAYS}) as DateTime from tg, range(0, {N_DAYS} + 1) r(j)),
v as (select e.TagName, e.j, e.DateTime, h.Value from e asof left join counter_history h on h.TagName = e.TagName and h.DateTime <= e.DateTime)
select TagName, DateTime, round(Value - lag(Value) over (partition by TagName order by j), {DIGITS}) as Value
from v qualify j >= 1""")
def q_buckets_dif(spark, sf_dir):
    d = derived(spark, sf_dir, "counter")
    return rounded(bk.buckets(d.history, FROM, TO, N_DAYS, "dif", tree=d.tree))


# ---- events and paging (WIN, SRT) -------------------------------------------------
from tagscope.operators import events as ev  # noqa: E402
from tagscope.operators import filters as flt  # noqa: E402
from tagscope.operators import paging as pg  # noqa: E402

NTH = 2
PAGE = 3
MASK = "A20_WT_1*"

_TRANSITIONS = f"""
with {V_STATE}
select TagName, DateTime from (
  select TagName, DateTime, Value, lag(Value) over (partition by TagName order by DateTime) as was,
         lag(DateTime) over (partition by TagName order by DateTime) as was_date
  from state_history where DateTime between {ts(FROM)} and {ts(TO)})
where Value = {{v}} and (was_date is null or Value <> was)"""


@register("down_events", _TRANSITIONS.format(v="0.0"))
def q_down_events(spark, sf_dir):
    return ev.down_events(td.state_history(spark, sf_dir), FROM, TO)


@register("up_events", _TRANSITIONS.format(v="1.0"))
def q_up_events(spark, sf_dir):
    return ev.up_events(td.state_history(spark, sf_dir), FROM, TO)


@register("nth_down_event", f"""
select TagName, DateTime from ({_TRANSITIONS.format(v="0.0")}) e
qualify row_number() over (partition by TagName order by DateTime) = {NTH + 1}""")
def q_nth_down_event(spark, sf_dir):
    return ev.nth_event(ev.down_events(td.state_history(spark, sf_dir), FROM, TO), NTH)


@register("tag_list_mask", f"""
with {V_HISTORY}
select distinct TagName from history where TagName like '{flt.mask_to_like(MASK)}'""")
def q_tag_list_mask(spark, sf_dir):
    return flt.tag_list(dim.tags(derived(spark, sf_dir).dimension), MASK)


@register("page_of_tags", f"""
with {V_STATE}
select TagName from (select distinct TagName from state_history) order by TagName
limit {pg.PER_PAGE} offset {(PAGE - 1) * pg.PER_PAGE}""")
def q_page_of_tags(spark, sf_dir):
    return pg.page(dim.tags(derived(spark, sf_dir, "state").dimension), ["TagName"], PAGE)


@register("load_mark", f"""
with {V_HISTORY}
select max(DateTime) as LoadMark from history""")
def q_load_mark(spark, sf_dir):
    return dim.load_mark(derived(spark, sf_dir).dimension)


# ---- column jobs: time normalisation, decoding, logs, formatting (COL, SRC9) -----
from tagscope.functions import numbers as num  # noqa: E402
from tagscope.functions import tagdecode as dec  # noqa: E402
from tagscope.functions import timeparse as tp  # noqa: E402
from tagscope.sources import logs as lg  # noqa: E402

LATEST_K = 20
ROUND = num.DEFAULT_ROUND



def _raw_times_sql() -> tuple[str, str]:
    """(raw text, the time it stands for) of every kind, from the event's own time."""
    raws, times = [], []
    for pattern, digits, minutes, end in td.RAW_TIME_KINDS:
        fmt = pattern.replace("'T'", "T")
        for spark_name, duck in (("yyyy", "%Y"), ("MM", "%m"), ("dd", "%d"), ("HH", "%H"), ("mm", "%M"), ("ss", "%S")):
            fmt = fmt.replace(spark_name, duck)
        t = f"ts + to_minutes({minutes or 0})"
        frac = f" || '.' || left(strftime({t}, '%f'), {digits})" if digits else ""
        raws.append(f"strftime({t}, '{fmt}'){frac} || '{end}'")
        unit = 60_000_000 if ":ss" not in pattern else 10 ** (6 - digits)
        times.append(f"make_timestamp(epoch_us(ts) // {unit} * {unit})")
    x = "(epoch_us(ts) // 86400000000 + (epoch_us(ts) % 86400000000 * 100000000 // 86400000000) / 100000000.0)"
    raws += ["cast(epoch_us(ts) // 86400000000 + 25569 as varchar) || ',' || "
             "lpad(cast((epoch_us(ts) % 86400000000) * 100000000 // 86400000000 as varchar), 8, '0')",
             "cast(epoch_us(ts) // 1000 as varchar)", *[f"'{b}'" for b in td.RAW_TIME_BAD], "'bad-' || event_id"]
    times += [f"make_timestamp(trunc(({x} + 25569.0 - 25569.0) * 86400.0)::bigint * 1000000)",
              "make_timestamp(epoch_us(ts) // 1000 * 1000)", *["null" for _ in td.RAW_TIME_BAD], "null"]
    def case(xs):
        return f"case event_id % {len(xs)} " + " ".join(f"when {i} then {x}" for i, x in enumerate(xs)) + " end"
    return case(raws), case(times)


@register("timestamps_normalised", f"""
with r as (select event_id, {_raw_times_sql()[0]} as raw, {_raw_times_sql()[1]} as DateTime from events)
select event_id, raw, DateTime,
  case when DateTime is not null then null when starts_with(raw, 'bad-') then '{tp.ERR_NOT_A_FLOAT}' else '{tp.ERR_INVALID_DATE}' end as error
from r""")
def q_timestamps_normalised(spark, sf_dir):
    return tp.normalise_times(td.raw_times(spark, sf_dir))


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _duck_field(regex: str, spec: dict) -> str:
    import re as _re
    group = int(spec.get("group", 0))
    value = spec.get("value")
    has_group = group != -1 and group + 1 <= _re.compile(regex).groups
    cap = f"regexp_extract(TagName, {_sql_str(regex)}, {group + 1})"
    if isinstance(value, str) and group == -1:
        return _sql_str(value)
    if isinstance(value, dict) and has_group and value:
        whens = " ".join(f"when {_sql_str(k)} then {_sql_str(v)}" for k, v in value.items())
        return f"(case {cap} {whens} else {cap} end)"
    return cap if has_group else "''"


def decode_sql(classifier: dict) -> str:
    per: dict = {}
    for cls in classifier.values():
        m = f"regexp_matches(TagName, {_sql_str(cls['regex'])})"
        for f, spec in cls.get("on_match", {}).items():
            per.setdefault(f, []).append(f"case when {m} then {_duck_field(cls['regex'], spec)} end")
    cols = [f for f in dec.FIELDS_ORDER if f in per]
    exprs = [(f"coalesce({', '.join(reversed(per[f]))})" if len(per[f]) > 1 else per[f][0]) + f" as {f}" for f in cols]
    return "select TagName as tag_name, " + ", ".join(exprs)


# Texts of the registered rows: a table of codes, made by rule from the fixture's codes.
TAG_TEXTS = ([("area_descr", a[1:], f"section {a[1:]}") for a in td.TAG_AREAS if a[1:].isdigit() and a != "A35"]
             + [("device_type", d, f"{d.lower()} device") for d in td.TAG_DEVICES if d and d != "CVR"]
             + [("tag_descr", x, f"signal {x}") for x in ("AH", "HI", "URS")] + [("tag_hand", "A20_WT_07_TOT", "seventh total")])
TAG_CLASSES = dec.with_texts(TAG_TEXTS)

V_TAG_NAMES = f"""tag_names as (select distinct concat_ws('_', (['{"','".join(td.TAG_AREAS)}'])[p_partkey % 5 + 1],
  nullif((['{"','".join(td.TAG_DEVICES)}'])[p_size % 6 + 1], ''), lpad(cast(p_partkey % 100 as varchar), 2, '0'))
  || (['{"','".join(td.TAG_SUFFIXES)}'])[p_partkey % 7 + 1] as TagName from part)"""


@register("tag_dimension", f"""
with {V_TAG_NAMES}
{decode_sql(TAG_CLASSES)} from tag_names""")
def q_tag_dimension(spark, sf_dir):
    texts = spark.createDataFrame(TAG_TEXTS, "field string, code string, text string")
    return dec.decode_tags(td.tag_names(spark, sf_dir), dec.with_texts(texts))


def _units_sql() -> str:
    parts = []
    for codes, unit in dec.UNIT_BY_DEVICE:
        parts.append(f"when device_type_id in ({', '.join(_sql_str(c) for c in codes)}) then {_sql_str(unit)}")
    for frags, unit in dec.UNIT_BY_FRAGMENT:
        cond = " or ".join(f"contains(lower(tag_name), {_sql_str(f)})" for f in frags)
        parts.append(f"when {cond} then {_sql_str(unit)}")
    parts.append("when tag_type in ('alarm', 'state') then ''")
    return "case " + " ".join(parts) + f" else {_sql_str(dec.NO_UNIT)} end"


def _descr_sql() -> str:
    head = ("case when coalesce(device_type, '') <> '' and coalesce(device_num, '') <> '' then device_type || ' No ' || device_num "
            f"when coalesce(device_type, '') <> '' then device_type else {_sql_str(dec.GENERIC_DESCRIPTION)} end")
    area = ("case when coalesce(area_descr, '') <> '' then ' (' || area_descr || ')' "
            "when coalesce(area, '') <> '' then ' (' || area || ')' else '' end")
    descr = "case when coalesce(tag_descr, '') <> '' then ' - ' || tag_descr else '' end"
    s = f"({head}) || ({area}) || ({descr})"
    return f"upper(substr({s}, 1, 1)) || substr({s}, 2)"


@register("tag_units", f"""
with {V_TAG_NAMES}, d as ({decode_sql(TAG_CLASSES)} from tag_names)
select tag_name, {_units_sql()} as unit, {_descr_sql()} as description from d""")
def q_tag_units(spark, sf_dir):
    return dec.tag_units(td.tag_names(spark, sf_dir), TAG_CLASSES)


V_LOG_LINES = """log_lines as (select event_id, case event_id % 3
  when 0 then '{"time":"' || t || '","level":"' || lvl || '","msg":"' || msg || '"}'
  when 1 then 'time=' || t || ' level=' || lower(lvl) || ' msg="' || msg || '"'
  else msg || ' at ' || t end as value
  from (select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as t,
        case event_type when 'error' then 'ERROR' when 'signup' then 'WARN' else 'INFO' end as lvl,
        'event ' || event_id || ' ' || event_type as msg from events))"""

LOGS_PARSED_SQL = r"""
select event_id,
  case when (case when json_valid(value) then json_type(value) = 'OBJECT' else false end) then try_strptime(json_extract_string(value, '$.time'), '%Y-%m-%dT%H:%M:%SZ')
       else try_strptime(regexp_extract(value, '^.*(?:^|\s)time=(\S*)', 1), '%Y-%m-%dT%H:%M:%SZ') end as time,
  case when (case when json_valid(value) then json_type(value) = 'OBJECT' else false end) then json_extract_string(value, '$.level')
       when regexp_matches(value, '(?:^|\s)level=') then regexp_extract(value, '^.*(?:^|\s)level=(\S*)', 1)
       else 'UNKNOWN' end as level,
  case when (case when json_valid(value) then json_type(value) = 'OBJECT' else false end) then json_extract_string(value, '$.msg')
       when strpos(value, 'msg=') > 0 then
         case when length(substr(value, strpos(value, 'msg=') + 4)) >= 2
                   and starts_with(substr(value, strpos(value, 'msg=') + 4), '"')
                   and ends_with(substr(value, strpos(value, 'msg=') + 4), '"')
              then substr(substr(value, strpos(value, 'msg=') + 4), 2, length(substr(value, strpos(value, 'msg=') + 4)) - 2)
              else substr(value, strpos(value, 'msg=') + 4) end
       else value end as msg
from log_lines where value <> ''"""


@register("logs_parsed", f"with {V_LOG_LINES}\n{LOGS_PARSED_SQL}")
def q_logs_parsed(spark, sf_dir):
    return lg.parse_log_lines(td.log_lines(spark, sf_dir))


@register("latest_logs", f"""
with {V_LOG_LINES}, parsed as ({LOGS_PARSED_SQL})
select time, level, msg from parsed order by time desc nulls last, msg desc limit {LATEST_K}""")
def q_latest_logs(spark, sf_dir):
    logs = lg.parse_log_lines(td.log_lines(spark, sf_dir)).select("time", "level", "msg")
    return pg.latest(logs, "time", LATEST_K, tiebreak=["msg"])


@register("values_formatted", f"""
with {V_HISTORY}, v as (select TagName, max(DateTime) as DateTime, arg_max(Value, DateTime) as Value
  from history where DateTime <= {ts(AT)} group by TagName)
select TagName, strftime(DateTime, '%Y-%m-%d %H:%M:%S') as date,
  round(Value * {10 ** ROUND}.0) / {10 ** ROUND}.0 as value,
  replace(regexp_replace(cast(round(Value * {10 ** ROUND}.0) / {10 ** ROUND}.0 as varchar), '\\.0$', ''), '.', ',') as text
from v""")
def q_values_formatted(spark, sf_dir):
    v = pit.value_at(td.history(spark, sf_dir), AT)
    r = num.round_half_away(F.col("Value"), ROUND)
    return v.select("TagName", F.date_format("DateTime", "yyyy-MM-dd HH:mm:ss").alias("date"),
                    r.alias("value"), num.decimal_comma(r).alias("text"))


# ---- templates and chart exports (TPL, EXP) ----------------------------------------
from tagscope.plans import templates as tpl  # noqa: E402
from tagscope.sinks import export as exp  # noqa: E402

# A stored query in the reference's placeholder style.
TEMPLATE_NAME = "tag_stats"
TEMPLATE_BODY = ("select TagName, count(*) as n, round(avg(Value), 6) as avg_value, round(max(Value), 6) as max_value "
                 "from history where DateTime >= '{from}' and DateTime < '{to}' group by TagName")


@register("template_exec", f"""
with {V_HISTORY}
select TagName, count(*) as n, round(avg(Value), 6) as avg_value, round(max(Value), 6) as max_value
from history where DateTime >= {ts(FROM)} and DateTime < {ts(TO)} group by TagName""")
def q_template_exec(spark, sf_dir):
    td.history(spark, sf_dir).createOrReplaceTempView("history")
    templates = tpl.template_table(spark, [(TEMPLATE_NAME, TEMPLATE_BODY), ("tag_count", "select count(distinct TagName) as n from history")])
    return tpl.template_exec(spark, templates, TEMPLATE_NAME, {"from": FROM, "to": TO})


_BUCKET_AVG_SQL = f"""{V_HISTORY}, b as ({buckets_sql(N_BUCKETS)}),
tg as (select distinct TagName from history where DateTime >= {ts(FROM)} and DateTime < {ts(TO)}),
a as (select h.TagName, b.i, avg(h.Value) as v from history h join b on h.DateTime >= b.lo and h.DateTime < b.hi group by all),
ba as (select tg.TagName, b.hi as DateTime, round(round(a.v, {DIGITS}) * 100.0) / 100.0 as v
       from tg cross join b left join a on a.TagName = tg.TagName and a.i = b.i)"""


@register("grafana_by_time", f"""
with {_BUCKET_AVG_SQL}
select strftime(DateTime, '%Y-%m-%dT%H:%M:%SZ') as time,
       to_json({{'time': strftime(DateTime, '%Y-%m-%dT%H:%M:%SZ'),
                 'data': list({{'name': TagName, 'value': v}} order by TagName, v nulls first)}})::varchar as json
from ba group by DateTime""")
def q_grafana_by_time(spark, sf_dir):
    # the chart of the registered bucket result (6-digit means, as in buckets_raw)
    return exp.grafana_by_time(q_buckets_raw(spark, sf_dir))


N_POINTS = 1488      # half hours of the range: points of every document
_POINTS_SQL = _BUCKET_AVG_SQL.replace(f"b as ({buckets_sql(N_BUCKETS)})", f"b as ({buckets_sql(N_POINTS)})")


def _points(spark, sf_dir):
    return rounded(bk.buckets(td.history(spark, sf_dir), FROM, TO, N_POINTS, "avg", mode="raw"))


def _documents(spark, write, df, suffix=".json"):
    path = f"{shared_dir(spark)}/documents-{uuid.uuid4().hex}"
    return exp.read_documents(write(df, path), path, suffix)


@register("grafana_by_series", f"""
with {_POINTS_SQL}
select TagName as doc, '{{"target":"' || TagName || '","datapoints":[' ||
       string_agg('[' || coalesce(regexp_replace(cast(v as varchar), '\\.0$', ''), 'null') || ',' || (epoch_us(DateTime) // 1000) || ']', ',' order by DateTime)
       || ']}}' as text
from ba group by TagName""")
def q_grafana_by_series(spark, sf_dir):
    return _documents(spark, exp.write_grafana_series, _points(spark, sf_dir))


# ---- more surface: labelled average, exports as rows, full tag list ----------------
def _round2_sql(v: str) -> str:
    return f"round({v} * {10 ** ROUND}.0) / {10 ** ROUND}.0"


def _plain_sql(v: str) -> str:
    """Shortest plain text of a double (values here are far from exponent range)."""
    return f"regexp_replace(cast({v} as varchar), '\\.0$', '')"


@register("group_avg_labelled_from", f"""
with {V_HISTORY}
select TagName, {ts(FROM)} as DateTime, round(avg(Value), {DIGITS}) as Value
from history where DateTime >= {ts(FROM)} and DateTime < {ts(TO)} group by TagName""")
def q_group_avg_labelled_from(spark, sf_dir):
    return rounded(agg.average_labelled_from(td.history(spark, sf_dir), FROM, TO))


@register("tag_list_all", f"""
with {V_STATE}
select distinct TagName from state_history where TagName like '%'""")
def q_tag_list_all(spark, sf_dir):
    return flt.tag_list(dim.tags(derived(spark, sf_dir, "state").dimension), "")


@register("export_text_lines", f"""
with {V_HISTORY}
select concat_ws(chr(9), TagName, strftime(DateTime, '%Y-%m-%d %H:%M:%S'),
                 replace({_plain_sql(_round2_sql('Value'))}, '.', ',')) as value
from history where DateTime >= {ts(FROM)} and DateTime < {ts(TO)}""")
def q_export_text_lines(spark, sf_dir):
    return exp.text_lines(rs.range_raw(td.history(spark, sf_dir), FROM, TO), ROUND)


@register("export_json_records", f"""
with {V_HISTORY}
select TagName as name, strftime(DateTime, '%Y-%m-%d %H:%M:%S') as date,
       case when isnan({_round2_sql('Value')}) then 0.0 else {_round2_sql('Value')} end as value
from history where DateTime >= {ts(FROM)} and DateTime < {ts(TO)}""")
def q_export_json_records(spark, sf_dir):
    return exp.json_records(rs.range_raw(td.history(spark, sf_dir), FROM, TO), ROUND)


@register("export_xml_rows", f"""
with {V_HISTORY}
select '<row>' || chr(10) || '    <TagName>' || TagName || '</TagName>' || chr(10) ||
       '    <DateTime>' || strftime(DateTime, '%Y-%m-%d %H:%M:%S') || '</DateTime>' || chr(10) ||
       '    <Value>' || replace({_plain_sql(_round2_sql('Value'))}, '.', ',') || '</Value>' || chr(10) || '</row>' as value
from history where DateTime >= {ts(FROM)} and DateTime < {ts(TO)}""")
def q_export_xml_rows(spark, sf_dir):
    return exp.xml_rows(rs.range_raw(td.history(spark, sf_dir), FROM, TO), ROUND)


@register("export_tag_time_map", f"""
with {_POINTS_SQL}
select TagName as doc, '{{"' || TagName || '":{{' ||
       string_agg('"' || strftime(DateTime, '%Y-%m-%d %H:%M:%S') || '":' ||
                  coalesce('"' || replace(regexp_replace(cast(v as varchar), '\\.0$', ''), '.', ',') || '"', 'null'), ',' order by DateTime)
       || '}}}}' as text
from ba group by TagName""")
def q_export_tag_time_map(spark, sf_dir):
    return _documents(spark, exp.write_tag_time_maps, _points(spark, sf_dir))


@register("export_xml_documents", f"""
with {V_HISTORY}
select TagName as doc, '<data>' || chr(10) || string_agg(
       '<row>' || chr(10) || '    <TagName>' || TagName || '</TagName>' || chr(10) ||
       '    <DateTime>' || strftime(DateTime, '%Y-%m-%d %H:%M:%S') || '</DateTime>' || chr(10) ||
       '    <Value>' || replace({_plain_sql(_round2_sql('Value'))}, '.', ',') || '</Value>' || chr(10) || '</row>', chr(10) order by DateTime)
       || chr(10) || '</data>' as text
from history where DateTime >= {ts(FROM)} and DateTime < {ts(TO)} group by TagName""")
def q_export_xml_documents(spark, sf_dir):
    return _documents(spark, exp.write_xml_documents, rs.range_raw(td.history(spark, sf_dir), FROM, TO), ".xml")


@register("values_n_instants_guarded", f"""
with {V_HISTORY},
tg as (select distinct TagName from history
       where DateTime <= {ts(FROM)} + to_seconds(({N_INSTANTS} - 1) * (epoch({ts(TO)}) - epoch({ts(FROM)}))::bigint // {N_INSTANTS})),
inst as (select TagName, {ts(FROM)} + to_seconds((i * (epoch({ts(TO)}) - epoch({ts(FROM)}))::bigint) // {N_INSTANTS}) as DateTime
         from tg, range(0, {N_INSTANTS}) r(i))
select inst.TagName, inst.DateTime,
       case when inst.DateTime > (select max(DateTime) from history) then null else h.Value end as Value
from inst asof left join history h on h.TagName = inst.TagName and h.DateTime <= inst.DateTime""")
def q_values_n_instants_guarded(spark, sf_dir):
    d = derived(spark, sf_dir)
    return pit.values_at_instants(d.history, FROM, TO, N_INSTANTS, guard=True, mark=dim.load_mark(d.dimension), tree=d.tree)


V_SPARSE = ("sparse_history as (select concat('A20_WT_', lpad(cast(user_id % 20 as varchar), 2, '0')) as TagName, "
            "ts as DateTime, case when event_type <> 'view' then cast(value as double) end as Value from events)")


@register("values_held", f"""
with {V_SPARSE}
select TagName, DateTime, last_value(Value ignore nulls) over (partition by TagName order by DateTime
       rows between unbounded preceding and current row) as Value
from sparse_history""")
def q_values_held(spark, sf_dir):
    return ev.hold_previous(td.sparse_history(spark, sf_dir))


# ---- more modes, groups and tag lists -------------------------------------------
def _bucket_cte(n: int) -> str:
    return f"b as ({buckets_sql(n)})"


def _edge_values_sql(n: int) -> str:
    """Last known value of every tag at every edge (edge number, time, value)."""
    return (f"edges as (select i as edge, {ts(FROM)} + to_seconds((i * {T_SEC}) // {n}) as t from range(0, {n} + 1) r(i)), "
            f"tags as (select distinct TagName from history where DateTime <= {ts(TO)}), "
            f"ev as (select g.TagName, e.edge, e.t, h.Value as v from (select * from tags, edges) g "
            f"join edges e on e.edge = g.edge asof left join history h on h.TagName = g.TagName and h.DateTime <= e.t)")


@register("buckets_seeded", f"""
with {V_HISTORY}, {_bucket_cte(N_DAYS)}, {_edge_values_sql(N_DAYS)},
s as (select h.TagName, b.i, h.DateTime, h.Value from history h join b on h.DateTime between b.lo and b.hi
      union all select TagName, edge, t, v from ev where edge >= 1 and v is not null
      union all select TagName, edge + 1, t, v from ev where edge < {N_DAYS} and v is not null),
r as ({runs_sql("select * from s", 1, "TagName, i")})
select t.TagName, b.hi as DateTime, round(a.v, {DIGITS}) as Value from tags t cross join b
left join (select TagName, i, sum(v * (nxt - slot)) / sum(nxt - slot) as v from r group by all) a on a.TagName = t.TagName and a.i = b.i""")
def q_buckets_seeded(spark, sf_dir):
    d = derived(spark, sf_dir)
    return rounded(bk.buckets(d.history, FROM, TO, N_DAYS, "avg", mode="seeded", tree=d.tree))


for _g in ("avg", "count"):
    def _mk_cyclic(g):
        def q(spark, sf_dir):
            return rounded(bk.buckets(td.history(spark, sf_dir), FROM, TO, N_FEW, g, mode="cyclic"))
        return q
    register(f"buckets_cyclic_{_g}", f"""
with {V_HISTORY}, {_bucket_cte(N_FEW)}, tags as (select distinct TagName from history where DateTime < {ts(TO)}),
inst as (select t.TagName, b.i, b.hi, unnest(generate_series(b.lo, b.hi - interval 1 microsecond, interval {CYCLIC_MS} millisecond)) as DateTime
         from tags t cross join b),
cyc as (select n.TagName, n.i, n.hi, h.Value from inst n asof left join history h on h.TagName = n.TagName and h.DateTime <= n.DateTime)
select TagName, hi as DateTime, round({'avg(Value)' if _g == 'avg' else f'count(Value) * {CYCLIC_MS} / 3600000.0'}, {DIGITS}) as Value
from cyc group by TagName, hi""")(_mk_cyclic(_g))


@register("buckets_dif_interp", f"""
with {V_HISTORY}, edges as (select i as edge, {ts(FROM)} + to_seconds((i * {T_SEC}) // {N_FEW}) as t from range(0, {N_FEW} + 1) r(i)),
tags as (select distinct TagName from history), g as (select TagName, edge, t from tags, edges),
p as (select g.*, h.DateTime as bt, h.Value as bv from g asof left join history h on h.TagName = g.TagName and h.DateTime <= g.t),
q as (select p.*, h.DateTime as at_, h.Value as av from p asof left join history h on h.TagName = p.TagName and h.DateTime >= p.t),
v as (select TagName, edge, t, case when bt = at_ then bv when bt is null or at_ is null then null
      else bv + (epoch_us(t) - epoch_us(bt))::double / (epoch_us(at_) - epoch_us(bt))::double * (av - bv) end as v from q)
select x.TagName, x.t as DateTime, round(x.v - y.v, {DIGITS}) as Value from v x join v y on y.TagName = x.TagName and y.edge = x.edge - 1""")
def q_buckets_dif_interp(spark, sf_dir):
    return rounded(bk.buckets(td.history(spark, sf_dir), FROM, TO, N_FEW, "dif", mode="raw"))


@register("buckets_avgm_raw", f"""
with {V_HISTORY}, {_bucket_cte(N_DAYS)}, tags as (select distinct TagName from history where DateTime >= {ts(FROM)} and DateTime < {ts(TO)}),
a as (select h.TagName, b.i, avg(h.Value) as v from history h join b on h.DateTime >= b.lo and h.DateTime < b.hi group by all)
select t.TagName, b.hi as DateTime, round(a.v, {DIGITS}) as Value
from tags t cross join b left join a on a.TagName = t.TagName and a.i = b.i""")
def q_buckets_avgm_raw(spark, sf_dir):
    return rounded(bk.buckets(td.history(spark, sf_dir), FROM, TO, N_DAYS, "avgm", mode="raw"))


for _g, _sum in (("sum", "sum(v * (nxt - slot))"), ("min", "min(v)"), ("max", "max(v)")):
    def _mk_filled(g):
        def q(spark, sf_dir):
            return rounded(agg.aggregate(td.history(spark, sf_dir), FROM, TO, g, mode="filled"))
        return q
    register(f"group_filled_{_g}", f"""
with {V_HISTORY}, r as ({runs_sql(f"select * from history where DateTime between {ts(FROM)} and {ts(TO)}", 1)})
select TagName, {ts(TO)} as DateTime, round({_sum}, {DIGITS}) as Value from r group by TagName""")(_mk_filled(_g))


for _g, _sum in (("sum", "sum(v * (nxt - slot))"), ("min", "min(v)"), ("max", "max(v)")):
    def _mk_seeded(g):
        def q(spark, sf_dir):
            d = derived(spark, sf_dir)
            return rounded(agg.aggregate(d.history, FROM, TO, g, mode="seeded", tree=d.tree))
        return q
    register(f"group_filled_seeded_{_g}", f"""
with {V_HISTORY}, r as ({runs_sql(seeded_union_sql("history", FROM, TO), 1)})
select TagName, {ts(TO)} as DateTime, round({_sum}, {DIGITS}) as Value from r group by TagName""")(_mk_seeded(_g))


for _g in ("sum", "min", "max"):
    def _mk_cyclic(g):
        def q(spark, sf_dir):
            d = derived(spark, sf_dir)
            return rounded(agg.aggregate(d.history, FROM, TO, g, mode="cyclic", tree=d.tree))
        return q
    register(f"group_cyclic_{_g}", f"""
with {V_HISTORY}, {CYCLIC_INSTANTS}
select TagName, {ts(TO)} as DateTime, round({_g}(Value), {DIGITS}) as Value from cyc group by TagName""")(_mk_cyclic(_g))


ASKED = ("A20_WT_01", "A20_WT_07", "A20_NONE")
_ASKED_SQL = f"(values {', '.join(f'({chr(39)}{t}{chr(39)})' for t in ASKED)}) as n(TagName)"
for _g in ("avg", "count"):
    def _mk_asked(g):
        def q(spark, sf_dir):
            return rounded(agg.aggregate(td.history(spark, sf_dir), FROM, TO, g, mode="raw", tags=", ".join(ASKED)))
        return q
    register(f"group_{_g}_asked_tags", f"""
with {V_HISTORY}
select n.TagName, {ts(TO)} as DateTime, cast(round({_g}(h.Value), {DIGITS}) as double) as Value from {_ASKED_SQL}
left join history h on h.TagName = n.TagName and h.DateTime >= {ts(FROM)} and h.DateTime < {ts(TO)} group by n.TagName""")(_mk_asked(_g))


@register("range_raw_open", f"""
with {V_HISTORY}
select TagName, DateTime, Value from history where DateTime > {ts(AT)} and DateTime < {ts(AT_LATE)}""")
def q_range_raw_open(spark, sf_dir):
    return rs.range_raw(td.history(spark, sf_dir), AT, AT_LATE, bounds="()")


@register("value_exact", f"""
with {V_HISTORY}
select TagName, DateTime, Value from history where DateTime = (select max(DateTime) from history)""")
def q_value_exact(spark, sf_dir):
    h = td.history(spark, sf_dir)
    return pit.value_exact(h, h.agg({"DateTime": "max"}).first()[0])


for _name, _seeded in (("range_resampled_seeded_1s_hours", True), ("range_gapfill_1s_hours", False)):
    def _mk_hours(seeded):
        def q(spark, sf_dir):
            d = rs.resample(td.history(spark, sf_dir), FROM, TO, step_seconds=1, seeded=seeded)
            return d.groupBy("TagName", F.date_trunc("hour", "DateTime").cast("timestamp_ntz").alias("hour")).agg(
                F.count(F.lit(1)).alias("rows"), F.round(F.sum("Value"), 4).alias("total"), r6(F.min("Value")).alias("low"),
                r6(F.max("Value")).alias("high"), F.min("DateTime").alias("first"), F.max("DateTime").alias("last"))
        return q
    _rows = seeded_union_sql("history", FROM, TO) if _seeded else f"select * from history where DateTime between {ts(FROM)} and {ts(TO)}"
    register(_name, f"""
with {V_HISTORY}, r as ({runs_sql(_rows, 1)}),
grid as (select TagName, make_timestamp(s * 1000000) as DateTime, v from (select TagName, v, unnest(generate_series(slot, nxt - 1)) as s from r))
select TagName, date_trunc('hour', DateTime) as hour, count(*) as rows, round(sum(v), 4) as total, round(min(v), {DIGITS}) as low,
       round(max(v), {DIGITS}) as high, min(DateTime) as first, max(DateTime) as last from grid group by all""")(_mk_hours(_seeded))


# ---- many buckets: one row per tag and hour of a result of N rows per tag -------------------
N_MANY = 86_400      # of 31 s each


@register("buckets_many_hours", f"""
with {V_HISTORY}, tg as (select distinct TagName from history where DateTime >= {ts(FROM)} and DateTime < {ts(TO)}),
a as (select TagName, (epoch_us(DateTime) - epoch_us({ts(FROM)})) // {T_SEC // N_MANY * 1_000_000} + 1 as i,
             count(Value) as n from history where DateTime >= {ts(FROM)} and DateTime < {ts(TO)} group by all),
g as (select tg.TagName, b.i, {ts(FROM)} + to_seconds(b.i * {T_SEC // N_MANY}) as hi, coalesce(a.n, 0) as n
      from tg cross join range(1, {N_MANY} + 1) b(i) left join a on a.TagName = tg.TagName and a.i = b.i)
select TagName, date_trunc('hour', hi) as hour, count(*) as buckets, sum(n)::double as samples, count_if(n > 0)::bigint as filled,
       min(hi) as first, max(hi) as last from g group by all""")
def q_buckets_many_hours(spark, sf_dir):
    b = bk.buckets(td.history(spark, sf_dir), FROM, TO, N_MANY, "count", mode="raw")
    return b.groupBy("TagName", F.date_trunc("hour", "DateTime").cast("timestamp_ntz").alias("hour")).agg(
        F.count(F.lit(1)).alias("buckets"), F.sum("Value").alias("samples"), F.count_if(F.col("Value") > 0).alias("filled"),
        F.min("DateTime").alias("first"), F.max("DateTime").alias("last"))


# ---- ingest: lines of drops into rows and rejects (SRC3, SRC7) -------------------------------
from tagscope.sources import history as hs  # noqa: E402
from tagscope.streaming import drops, ingest  # noqa: E402


@register("drops_split", f"""
with l as (select event_id, 'hs_' || event_id % 5 || '.json.gz' as file, event_id % 8 as k, 'T' || event_id % 20 as tag,
                  strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as t, cast(value as varchar) as v, ts, value from events),
lines as (select *, case k when 0 then '{{"TagName":"' || tag || '","DateTime":"' || t || '"' when 1 then '{{"DateTime":"' || t || '","Value":1}}'
  when 2 then '{{"TagName":"' || tag || '","DateTime":"soon","Value":1}}' when 3 then null when 4 then 'begin of ' || event_id
  when 5 then '{{"TagName":"' || tag || '","DateTime":"' || t || '","Value":null}}'
  else '{{"TagName":"' || tag || '","DateTime":"' || t || '","Value":' || v || '}}' end as line from l)
select case when k >= 5 then 'row' else 'reject' end as kind, case when k >= 5 then tag end as TagName, case when k >= 5 then ts end as DateTime,
       case when k >= 6 then value::double end as Value, case when k < 5 then line end as line, case when k < 5 then file end as file,
       case k when 0 then 'malformed' when 1 then 'missing field' when 2 then 'malformed' when 3 then '{drops.UNREADABLE}' when 4 then '{drops.TOO_LONG}' end as reason
from lines""")
def q_drops_split(spark, sf_dir):
    """Lines as the drop source gives them: good ones, and by rule cut off, without a
    tag, without a time, of an unreadable file, too long, without a value."""
    e = td.table(spark, sf_dir, "events")
    k, tag = F.col("event_id") % 8, F.concat(F.lit("T"), (F.col("event_id") % 20).cast("string"))
    t = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    named = F.concat(F.lit('{"TagName":"'), tag, F.lit('","DateTime":"'))
    line = (F.when(k == 0, F.concat(named, t, F.lit('"'))).when(k == 1, F.concat(F.lit('{"DateTime":"'), t, F.lit('","Value":1}')))
            .when(k == 2, F.concat(named, F.lit('soon","Value":1}'))).when(k == 3, F.lit(None).cast("string"))
            .when(k == 4, F.concat(F.lit("begin of "), F.col("event_id").cast("string")))
            .when(k == 5, F.concat(named, t, F.lit('","Value":null}')))
            .otherwise(F.concat(named, t, F.lit('","Value":'), F.col("value").cast("string"), F.lit("}"))))
    problem = F.when(k == 3, drops.UNREADABLE).when(k == 4, drops.TOO_LONG)
    lines = e.select(F.concat(F.lit("hs_"), (F.col("event_id") % 5).cast("string"), F.lit(".json.gz")).alias("file"), line.alias("line"), problem.alias("problem"))
    good, rejects = ingest.split_batch(ingest.parse_lines(lines))
    return good.select(F.lit("row").alias("kind"), "TagName", "DateTime", "Value", *[F.lit(None).cast("string").alias(c) for c in ("line", "file", "reason")]) \
        .unionByName(rejects.select(F.lit("reject").alias("kind"), "line", "file", "reason"), allowMissingColumns=True)


@register("history_shapes", f"""
with {V_HISTORY}
select 'three' as shape, TagName, DateTime, Value from history
union all select 'spelled', TagName, DateTime, Value from history
union all select 'two', 'A20_WT_03', DateTime, Value from history where TagName = 'A20_WT_03'""")
def q_history_shapes(spark, sf_dir):
    h = td.history(spark, sf_dir)
    shapes = [("three", h.toDF("tag", "at", "number"), None),
              ("spelled", h.select(F.col("Value").cast("string").alias("v"), F.col("DateTime").alias("DataTime"), F.col("TagName").alias("t")), None),
              ("two", h.filter("TagName = 'A20_WT_03'").select("DateTime", "Value"), "A20_WT_03")]
    out = None
    for name, rows, tag in shapes:
        part = hs.normalize_history(rows, tag).withColumn("shape", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.select("shape", "TagName", "DateTime", "Value")


# ---- templates by prefix, ad hoc SQL (FLT4, TPL2, TPL3), CSV (EXP6) ---------------------------
PREFIX = "NATION_1"


@register("templates_by_prefix", f"""
select n_name as Name, 'select * from supplier where s_nationkey = ' || n_nationkey || ' and s_name like ' || chr(39) || '{{mask}}' || chr(39) as Body
from nation where starts_with(n_name, '{PREFIX}')""")
def q_templates_by_prefix(spark, sf_dir):
    body = F.concat(F.lit("select * from supplier where s_nationkey = "), F.col("n_nationkey").cast("string"), F.lit(" and s_name like '{mask}'"))
    stored = td.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("ID"), F.col("n_name").alias("Name"), body.alias("Body"))
    return tpl.template_list(stored, PREFIX)


@register("query_ad_hoc", f"""
with {V_HISTORY}
select TagName, date_trunc('day', DateTime) as day, count(*) as n, round(max(Value), {DIGITS}) as high from history
where Value > 50 group by all having count(*) > 1""")
def q_query_ad_hoc(spark, sf_dir):
    td.history(spark, sf_dir).createOrReplaceTempView("history")
    return tpl.exec_query(spark, f"select TagName, cast(date_trunc('day', DateTime) as timestamp_ntz) as day, count(*) as n, round(max(Value), {DIGITS}) as high "
                                 "from history where Value > :least group by 1, 2 having count(*) > 1", {"least": 50})


@register("export_csv_lines", f"""
with {V_HISTORY}
select '"' || TagName || '","' || strftime(DateTime, '%Y-%m-%dT%H:%M:%S.') || lpad((epoch_us(DateTime) // 1000 % 1000)::varchar, 3, '0') || '","' ||
       cast(Value as varchar) || '"' as value from history where DateTime >= {ts(FROM)} and DateTime < {ts(TO)}""")
def q_export_csv_lines(spark, sf_dir):
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    exp.write_csv(rs.range_raw(td.history(spark, sf_dir), FROM, TO), path)
    return spark.read.text(path).filter(F.col("value") != '"TagName","DateTime","Value"')


# ---- a deep page (SRT3), marks after late and replayed batches (STR2, SRC8) --------------------
DEEP_PAGE = 500      # of 23 rows: beyond what is taken as a top-k


@register("page_deep", f"""
with {V_HISTORY}, n as (select count(*) as n from history),
p as (select least({DEEP_PAGE}, greatest(1, (n + 22) // 23)) as p from n),
r as (select *, row_number() over (order by DateTime desc, TagName, Value) as rn from history)
select TagName, DateTime, Value from r, p where rn > (p - 1) * 23 and rn <= p * 23""")
def q_page_deep(spark, sf_dir):
    return pg.page(td.history(spark, sf_dir), [F.col("DateTime").desc(), F.col("TagName"), F.col("Value")], DEEP_PAGE)


@register("load_marks_replayed", f"""
with {V_HISTORY}, h as (select h.*, 'source ' || (epoch_us(DateTime) // 1000000 % 2) as source from history h)
select TagName, source, count(*) as records, max(DateTime) as LoadMark from h group by all""")
def q_load_marks_replayed(spark, sf_dir):
    """The dimension after batches that hold late data, a replay and a fold."""
    path = f"{shared_dir(spark)}/marks-{uuid.uuid4().hex}"
    h = td.history(spark, sf_dir).withColumn("second", F.unix_timestamp("DateTime"))
    source = F.concat(F.lit("source "), (F.col("second") % 2).cast("string"))
    late = [h.filter(F.pmod(F.xxhash64("DateTime"), F.lit(3)) == k) for k in (2, 0, 1)]
    for batch in (0, 1, 1, 2):
        dim.add_batch(late[batch], path, batch, source)
        if batch == 1:
            dim.fold(spark, path, 0)
    return dim.read_dimension(spark, path)
