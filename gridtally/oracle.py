"""The queries once more, as plain SQL over the test tables.

Written from the questions, not from the Spark plans: approximations are held against
their bounds by the query itself (the statement says that all are kept); events and flags are
joined per event, labels are joined back, order statistics come from row
numbers. Statements share building blocks through WITH clauses only.
"""

from __future__ import annotations

# Parameters shared with the Spark side.
SEED = 12
N_NEGATIVE = 100
N_PER_QUARTILE = 225
N_SIMPLE = 1_400
# Looking at three sites on one day is the whole point of that query.
N_EXTRACT = 3
WINDOW = ("2024-01-12 13:00:00", "2024-01-12 16:00:00")

_DENVER = "((({0}) at time zone 'UTC') at time zone 'America/Denver')"


def _exact(expr: str) -> str:
    """The decimal that a finite double prints as."""
    return f"(case when isfinite({expr}) then cast(cast({expr} as varchar) as decimal(38,18)) end)"


def _sum(expr: str, empty: str, places: int | None = None, mw: bool = False) -> str:
    """A decimal sum, rounded if asked for, as a double; infinities win, or cancel out.

    With ``mw`` it is a thousandth of the sum: the decimal point moves, nothing else.
    """
    plus = f"count(*) filter (where {expr} = 'inf'::double) > 0"
    minus = f"count(*) filter (where {expr} = '-inf'::double) > 0"
    finite = f"sum({_exact(expr)})"
    if mw:
        finite = f"cast(cast({finite} as varchar) || 'e-3' as decimal(38,21))"
    if places is not None:
        finite = f"round_even({finite}, {places})"
    return f"""(case when {plus} and {minus} then null when {plus} then 'inf'::double
      when {minus} then '-inf'::double else coalesce(cast({finite} as double), {empty}) end)"""


def _strict(expr: str, mw: bool = False) -> str:
    return f"(case when count(*) = count({expr}) then {_sum(expr, 'null', mw=mw)} end)"


def _sum0(expr: str, mw: bool = False) -> str:
    return _sum(expr, "0.0::double", mw=mw)


def _mw2(expr: str) -> str:
    """A kWh sum in MW at two places."""
    return _sum(expr, "0.0::double", 2, mw=True)


def _key_decimal(expr: str) -> str:
    return f"cast({expr} as decimal(28,9))"


_BLOCKS: dict[str, str] = {}

_BLOCKS["savings"] = """
    select
      case when event_id % 997 = 0 then null else cast(user_id as varchar) || '_AMI' end as item_id,
      case event_type when 'click' then 'Event 1' when 'view' then 'Event 2'
        when 'purchase' then 'Event 3' when 'signup' then 'Event 4'
        else 'Event ' || cast(event_id % 4 + 1 as varchar) end as event,
      event_type = 'error' as initial_export,
      cast(date_trunc('hour', ts) as timestamp) as ts_utc,
      case when event_id % 101 = 0 then null when event_id % 397 = 3 then 1e13::double
        when event_id % 397 in (5, 6) then 3e-10::double
        when event_type = 'signup' and event_id % 397 = 9 then 'inf'::double
        else round(value - 30.0, 2) end as metered_savings,
      case when event_id % 53 = 0 then null else event_id % 7 = 0 end as non_responsive
    from events"""

_BLOCKS["customers"] = """
    select cast(c_custkey as varchar) as customer_id,
      case when c_custkey % 13 = 0 then null
        when c_mktsegment in ('BUILDING','MACHINERY','HOUSEHOLD') then 'Yes'
        else 'No' end as event1_in_info,
      case when c_nationkey % 3 = 0 then 'No' else 'Yes' end as event2_in_info,
      case when c_custkey % 11 = 0 then null when c_acctbal < 3000 then 'No'
        else 'Yes' end as event3_in_info,
      case when c_nationkey % 5 = 0 and d.k = 0 then 'No' else 'Yes' end as event4_in_info
    from customer, (values (0), (1)) d(k)
    where d.k = 0 or c_custkey % 83 = 0"""

_BLOCKS["flags"] = """
    select distinct customer_id, event1_in_info, event2_in_info, event3_in_info, event4_in_info
    from customers"""

_BLOCKS["dropped"] = """
    select distinct regexp_replace(meter_raw, '_AMI$', '') as meter_id from (
      select cast(s_suppkey as varchar) || '_AMI' as meter_raw from supplier
        where s_nationkey % 4 in (0, 1) and s_suppkey % 3 = 0
      union all
      select cast(s_suppkey as varchar) || '_AMI' from supplier where s_suppkey % 9 = 0
    )"""

_BLOCKS["updated"] = "\n    union all\n".join(
    f"""    select s.*, regexp_replace(item_id, '_AMI$', '') as meter_id,
      f.event{k}_in_info = 'Yes' as in_event_info
    from savings s left join flags f
      on regexp_replace(s.item_id, '_AMI$', '') is not distinct from f.customer_id
    where not s.initial_export and s.event = 'Event {k}'"""
    for k in (1, 2, 3, 4)
)

_BLOCKS["clean"] = f"""
    select meter_id, event,
      case when metered_savings > 0 then 'Active'
        when metered_savings <= 0 then 'Inactive' end as customer_activity,
      ts_utc as "timestamp",
      local as colorado_time,
      strftime(local, '%H:%M:%S') || '-' || strftime(local + interval 1 hour, '%H:%M:%S')
        as "interval",
      metered_savings as savings_kwh,
      metered_savings / 1000 as savings_mw,
      in_event_info, non_responsive,
      exists (select 1 from dropped d where d.meter_id is not distinct from u.meter_id)
        as bad_meter
    from (select *, {_DENVER.format("ts_utc")} as local from updated) u"""

_BLOCKS["eligible"] = "select * from clean where bad_meter = false and in_event_info = true"

_BLOCKS["rowsign"] = f"""
    select event, "interval",
      {_mw2("(case when savings_kwh > 0 and non_responsive = false then savings_kwh end)")}
        as mw_reduction_active,
      {_mw2("(case when savings_kwh < 0 and non_responsive = false then savings_kwh end)")}
        as mw_reduction_inactive
    from eligible group by event, "interval" """

_BLOCKS["activity"] = f"""
    select meter_id, event, total as total_event_activity,
      case when total > 0 then 'Active' when total <= 0 then 'Inactive' end as activity_label
    from (select meter_id, event, {_strict("savings_kwh", mw=True)} as total
          from clean group by meter_id, event)"""

_BLOCKS["eventlabel"] = f"""
    select c.event, c."interval",
      {_mw2('''(case when activity_label = 'Active' and non_responsive = false
        then savings_kwh end)''')} as active,
      {_mw2('''(case when activity_label = 'Inactive' and non_responsive = false
        then savings_kwh end)''')} as inactive
    from eligible c left join activity a
      on c.meter_id is not distinct from a.meter_id and c.event is not distinct from a.event
    group by c.event, c."interval" """

_BLOCKS["responses"] = """
    select event, "interval",
      count(*) filter (where non_responsive = false) as n_active,
      count(*) filter (where non_responsive = true) as n_inactive
    from eligible group by event, "interval" """

# Documents that hold one object and nothing else.
_LOADED = " and ".join(
    f"user_id % {n} <> {n - 1}" for n in (29, 31, 37, 41, 43, 47, 53)
)

# Why the others are rejected.
_REASON = """case when user_id % 29 = 28 then 'truncated' when user_id % 31 = 30 then 'trailing text'
      when user_id % 37 = 36 then 'trailing text' when user_id % 41 = 40 then 'blank'
      when user_id % 43 = 42 then 'no object' when user_id % 47 = 46 then 'wrong field type'
      else 'malformed' end"""

_BLOCKS["hourly"] = f"""
    select cast(user_id as varchar) as id,
      case when event_id % 1013 <> 7 then {_DENVER.format("ts")} end as "time",
      case when event_id % 101 = 0 then 0.0::double
        when event_id % 1009 between 1 and 5 then null
        when user_id % 5 = 1 and event_id % 1013 = 11 then 1e13::double
        when user_id % 5 = 1 and event_id % 1013 = 12 then 3e-10::double
        else value end as savings,
      event_id % 101 <> 0 and event_id % 1009 between 1 and 5 as unreadable
    from events where {_LOADED}"""

_BLOCKS["modelled"] = f"""
    select id, {_strict("savings")} as model_metered_savings
    from hourly group by id"""

_BLOCKS["vendor"] = """
    select cast(c_custkey as varchar) || '_AMI' as item_id, c_acctbal / 10.0 as metered_savings
    from customer, (values (0), (1)) d(k)
    where c_custkey % 5 <> 1 and (d.k = 0 or c_custkey % 83 = 0)"""

_BLOCKS["compared"] = """
    select v.item_id as sample_id, m.id as model_id, v.metered_savings as vendor_estimation,
      m.model_metered_savings as model_estimation,
      abs(m.model_metered_savings - v.metered_savings) as absolute_savings_difference
    from modelled m left join vendor v
      on m.id is not distinct from regexp_replace(v.item_id, '_AMI$', '')"""

_BLOCKS["reads"] = """
    select cast(l_partkey as varchar) as account_id,
      cast(year(l_shipdate) as int) as year, cast(month(l_shipdate) as int) as month,
      cast(day(l_shipdate) as int) as day, cast(l_quantity as int) % 24 as hour,
      case when l_orderkey % 211 = 0 then null when l_partkey % 7 = 0 then 0.125::double
        else l_extendedprice / 10000.0 end as kwh
    from lineitem"""

_BLOCKS["sites"] = """
    select cast(p_partkey as varchar) as model_id from part where p_size % 4 = 0
    union all select 'missing_site'"""

_BLOCKS["site_reads"] = """
    select account_id as id, year, month, day, hour, kwh from reads
    where account_id in (select model_id from sites)"""

_BLOCKS["local_reads"] = f"""
    select id, cast(year(t) as int) as year, cast(month(t) as int) as month,
      cast(day(t) as int) as day, cast(hour(t) as int) as hour, kwh, t
    from (select id, kwh,
      {_DENVER.format("make_timestamp(year, month, day, hour, 0, 0.0)")} as t from site_reads)"""

_BLOCKS["frame"] = """
    select cast(o_orderkey as varchar) || '_AMI' as item_id,
      (o_totalprice - 100000.0) / 1000.0 as metered_savings
    from (select *, unnest(range(case when o_orderkey < 12 and o_totalprice < 100000
                                 then 2500 else 1 end)) from orders)"""

_BLOCKS["ordered"] = """
    select metered_savings as x, row_number() over (order by metered_savings) - 1 as r,
      count(*) over () as n
    from frame where metered_savings >= 0"""


def _quartile(p: float) -> str:
    """Interpolated order statistic: (1 - share) * below + share * above."""
    at = f"((n - 1) * {p}::double)"
    below = f"max(x) filter (where r = floor({at}))"
    above = f"max(x) filter (where r = ceil({at}))"
    share = f"max({at} - floor({at}))"
    return (
        f"case when {share} = 0 then {below} "
        f"else (1 - {share}) * {below} + {share} * {above} end"
    )


_BLOCKS["quartiles"] = f"""
    select {_quartile(0.0)} as p0, {_quartile(0.25)} as p25, {_quartile(0.5)} as p50,
      {_quartile(0.75)} as p75, {_quartile(1.0)} as p100
    from ordered"""

_BLOCKS["strata"] = """
    select f.*,
      case when metered_savings < 0 then 'NEG'
        when metered_savings >= p0 and metered_savings < p25 then 'Q1'
        when metered_savings >= p25 and metered_savings < p50 then 'Q2'
        when metered_savings >= p50 and metered_savings < p75 then 'Q3'
        when metered_savings >= p75 then 'Q4' end as stratum
    from frame f, quartiles"""

_BLOCKS["keyed"] = f"""
    select stratum, item_id, metered_savings,
      md5(concat_ws(':', '{SEED}', coalesce(item_id, 'NA'),
        coalesce(cast({_key_decimal("metered_savings")} as varchar), 'NA'),
        cast(row_number() over (partition by item_id, metered_savings) - 1 as varchar))) as k
    from strata"""

_BLOCKS["sampled"] = f"""
    select stratum, item_id, metered_savings from (
      select *, row_number() over (partition by stratum order by k, item_id, metered_savings) as r
      from keyed)
    where r <= case when stratum = 'NEG' then {N_NEGATIVE} else {N_PER_QUARTILE} end"""

# Blocks each block reads, so that a statement carries only what it needs.
_NEEDS = {
    "flags": ["customers"],
    "updated": ["savings", "flags"],
    "clean": ["updated", "dropped"],
    "eligible": ["clean"],
    "rowsign": ["eligible"],
    "activity": ["clean"],
    "eventlabel": ["eligible", "activity"],
    "responses": ["eligible"],
    "modelled": ["hourly"],
    "compared": ["modelled", "vendor"],
    "site_reads": ["reads", "sites"],
    "local_reads": ["site_reads"],
    "ordered": ["frame"],
    "quartiles": ["ordered"],
    "strata": ["frame", "quartiles"],
    "keyed": ["strata"],
    "sampled": ["keyed"],
}


def _with(needs: list[str], body: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        for needed in _NEEDS.get(name, []):
            visit(needed)
        if name not in order:
            order.append(name)

    for name in needs:
        visit(name)
    blocks = ",\n".join(f"{name} as ({_BLOCKS[name]})" for name in order)
    return f"with {blocks}\n{body}" if blocks else body


def _totals(keys: str) -> str:
    return f"""select id, {keys}, count(*) as n_observations,
      {_strict("kwh")} as total_kwh
    from local_reads group by id, {keys}"""


def _rung(name: str, condition: str) -> str:
    return f"""select '{name}' as scenario, event, "interval",
      count(*) filter (where customer_activity = 'Active') as n_active,
      count(*) filter (where customer_activity = 'Inactive') as n_inactive
    from clean where {condition} group by event, "interval" """


def statements() -> dict[str, str]:
    bins = ", ".join(
        f"""('rows_in_bin', '{q}', (select cast(count(*) as double) from binned
        where bin = '{q}'))"""
        for q in ("Q1", "Q2", "Q3", "Q4")
    )
    breaks = ", ".join(
        f"('break', '{label}', (select cast(round_even({_exact(name)}, 2) as double) from quartiles))"
        for label, name in (
            ("0%", "p0"),
            ("25%", "p25"),
            ("50%", "p50"),
            ("75%", "p75"),
            ("100%", "p100"),
        )
    )
    mean = f"cast(sum({_exact('absolute_savings_difference')}) as double)"
    return {
        "q_flags_distinct": _with(["flags"], "select * from flags"),
        "q_flag_fanout": _with(
            ["flags"],
            """select customer_id, count(*) as n_versions from flags
            group by customer_id having count(*) > 1""",
        ),
        "q_drop_list": _with(["dropped"], "select * from dropped"),
        "q_initial_union": _with(
            ["savings"],
            f"""select event, count(*) as n_rows,
              {_sum0("metered_savings")} as total_kwh
            from savings where initial_export group by event""",
        ),
        "q_updated_union": _with(
            ["savings"],
            f"""select event, count(*) as n_rows,
              {_sum0("metered_savings")} as total_kwh,
              count(case when event <> 'Event 3' then non_responsive end) as n_flagged
            from savings where not initial_export group by event""",
        ),
        "q_savings_clean": _with(["clean"], "select * from clean"),
        "q_site_export": _with(
            ["clean"],
            f"""select meter_id, in_event_info, non_responsive, bad_meter,
              {_strict("savings_kwh")} as savings_kwh
            from clean where event = 'Event 1' and savings_kwh > 0
            group by meter_id, in_event_info, non_responsive, bad_meter""",
        ),
        "q_interval_rowsign": _with(
            ["rowsign"], 'select * from rowsign order by event, "interval"'
        ),
        "q_customer_activity": _with(
            ["activity"],
            "select * from activity",
        ),
        "q_customer_activity_skipna": _with(
            ["clean"],
            f"""select meter_id, event, {_sum0("savings_kwh", mw=True)} as event_savings,
              case when {_sum0("savings_kwh", mw=True)} > 0 then 'Active' else 'Inactive' end
                as customer_activity
            from clean group by meter_id, event""",
        ),
        "q_interval_eventlabel": _with(
            ["eventlabel"],
            """select event, "interval", active as mw_reduction_active,
              inactive as mw_reduction_inactive from eventlabel""",
        ),
        "q_event_totals": _with(
            ["eligible"],
            f"""select event, {_mw2("savings_kwh")} as mw_reduction_active,
              count(distinct row(meter_id)) as total_participants
            from eligible group by event""",
        ),
        "q_response_counts": _with(["responses"], "select * from responses"),
        "q_interval_combined": _with(
            ["rowsign", "responses"],
            """select s.event, s."interval", mw_reduction_active, n_active,
              mw_reduction_inactive, n_inactive
            from rowsign s left join responses n
              on s.event is not distinct from n.event
              and s."interval" is not distinct from n."interval" """,
        ),
        "q_event_rounded_totals": _with(
            ["eventlabel"],
            f"""select event, {_sum("active", "null")} as total_kwh_active,
              {_sum("inactive", "null")} as total_kwh_inactive
            from eventlabel group by event""",
        ),
        "q_filter_ladder": _with(
            ["clean"],
            "\nunion all\n".join(
                [
                    _rung("badmeter", "bad_meter = false"),
                    _rung("ineventinfo", "in_event_info = true"),
                    _rung("nonresponsive", "non_responsive = false"),
                    _rung("nofilters", "true"),
                ]
            ),
        ),
        "q_interval_keys": _with(
            ["eligible"], 'select event, "interval" from eligible group by event, "interval"'
        ),
        "q_model_flatten": _with(
            ["hourly"], 'select id, "time", savings, unreadable from hourly'
        ),
        "q_model_site_savings": _with(["modelled"], "select * from modelled"),
        "q_model_vs_vendor": _with(["compared"], "select * from compared"),
        "q_mean_abs_diff": _with(
            ["compared"],
            f"""select
              case when count(*) = count(absolute_savings_difference)
                then {mean} / count(absolute_savings_difference) end as mean_difference,
              {mean} / nullif(count(absolute_savings_difference), 0) as matched_mean_difference,
              count(*) as n_rows, count(absolute_savings_difference) as n_matched
            from compared""",
        ),
        "q_diff_histogram": _with(
            ["compared"],
            """select bin, n_sites, bin * 0.1::double as bin_center from (
              select ceil(absolute_savings_difference / 0.1::double
                - (0.5::double + 1e-8::double)) as bin, count(*) as n_sites
              from compared where absolute_savings_difference is not null group by 1)""",
        ),
        "q_model_fit": _with(
            ["compared"],
            """select
              round(regr_slope(model_estimation, vendor_estimation), 6) as slope,
              round(regr_intercept(model_estimation, vendor_estimation), 6) as intercept,
              round(regr_r2(model_estimation, vendor_estimation), 6) as r2,
              cast(regr_count(model_estimation, vendor_estimation) as bigint) as n_sites
            from compared""",
        ),
        "q_event_window": _with(
            ["hourly"],
            f"""select id, {_strict("savings")} as model_metered_savings
            from hourly
            where "time" >= timestamp '{WINDOW[0]}' and "time" <= timestamp '{WINDOW[1]}'
            group by id""",
        ),
        "q_document_load_report": f"""
            select case when {_LOADED} then 'loaded' else 'rejected' end as status,
              count(distinct (user_id, event_id // 5000)) as n_documents,
              count(*) filter (where {_LOADED}) as n_values,
              count(*) filter (where {_LOADED} and event_id % 101 <> 0
                and event_id % 1009 between 1 and 5) as n_unreadable,
              count(*) filter (where {_LOADED} and event_id % 1013 = 7) as n_unreadable_times
            from events group by 1""",
        "q_reject_reasons": f"""
            select {_REASON} as reason, count(distinct (user_id, event_id // 5000)) as n_documents
            from events where not ({_LOADED}) group by 1""",
        "q_hourly_rows": """
            select event_id, "row"::int as "row",
              case when event_id % 3 = 0 then true end as checked,
              "row"::bigint as hour,
              case "row" when 0 then value
                when 1 then case when event_id % 4 <> 0 then event_id end end::double as load,
              event_type as model_fit_name, round(value / 100, 4) as model_r2,
              user_id::varchar as site,
              case when event_id % 2 = 0 then event_id::varchar else '"odd"' end as tag
            from events, (values (0), (1), (2)) places("row")
            where event_id % 19 <> 18""",
        "q_hourly_profile": """
            with texts as (
              select left(props, length(props) - 1) || ', "site": "' || user_id || '"'
                || case when event_id % 3 = 0 then ', "checked": true' else '' end || '}' as doc
              from events
            ), fields as (
              select key, json_type(doc, '$.' || key) as type
              from (select doc, unnest(json_keys(doc)) as key from texts)
            )
            select key as field, count(*) as n_documents,
              case max(type) when 'UBIGINT' then 'BIGINT' when 'VARCHAR' then 'STRING'
                else max(type) end as type
            from fields group by key""",
        "q_reads_local": _with(
            ["local_reads"], "select id, year, month, day, hour, kwh from local_reads"
        ),
        "q_reads_month": _with(["local_reads"], _totals("year, month")),
        "q_reads_day": _with(["local_reads"], _totals("year, month, day")),
        "q_reads_hour": _with(["local_reads"], _totals("year, month, day, hour")),
        "q_reads_distinct": _with(
            ["local_reads"],
            """select t as "timestamp", count(distinct row(kwh)) as unique_kwh_readings,
              count(distinct row(id)) as unique_sites,
              count(distinct row(kwh)) / count(distinct row(id)) as kwh_readings_per_site
            from local_reads group by t""",
        ),
        "q_reads_distinct_approx": _with(
            ["local_reads"],
            """select year, month, day, count(*) as n_observations,
              count(distinct row(kwh)) as unique_kwh_readings,
              count(distinct row(id)) as unique_sites,
              true as unique_kwh_readings_close, true as unique_sites_close
            from local_reads group by year, month, day""",
        ),
        "q_reads_dups": _with(
            ["site_reads"],
            """select id, year, month, day, hour, count(*) as n from site_reads
            group by id, year, month, day, hour having count(*) > 1""",
        ),
        "q_reads_extract": _with(
            ["local_reads"],
            f""", first_sites as (
              select distinct id from local_reads order by id limit {N_EXTRACT}
            ), last_day as (
              select max(cast(t as date)) as day from local_reads
              where id in (select id from first_sites))
            select * from ({_totals("year, month, day, hour")})
            where id in (select id from first_sites)
              and make_date(year, month, day) = (select day from last_day)""",
        ),
        "q_site_coverage": _with(
            ["sites", "site_reads"],
            """select found, count(*) as n_sites from (
              select exists (select 1 from site_reads r where r.id = s.model_id) as found
              from sites s) group by found""",
        ),
        "q_same_month_total": _with(
            ["local_reads"],
            f"""select year, month, total as total_kwh, id, n_sites from (
              select *, count(*) over (partition by year, month, total) as n_sites from (
                select id, year, month, {_strict("kwh")} as total
                from local_reads group by id, year, month)
              where total is not null)
            where n_sites > 1""",
        ),
        "q_quartiles": _with(["quartiles"], "select * from quartiles"),
        "q_quartiles_approx": """select p::double as probability, true as close
            from (values (0.0), (0.25), (0.5), (0.75), (1.0)) t(p)""",
        "q_stratified_sample": _with(["sampled"], "select * from sampled"),
        "q_simple_sample": _with(
            ["frame"],
            f"""select item_id from (
              select item_id, md5(concat_ws(':', '{SEED}', coalesce(item_id, 'NA'),
                cast(row_number() over (partition by item_id) - 1 as varchar))) as k from frame)
            order by k, item_id limit {N_SIMPLE}""",
        ),
        "q_sample_check": _with(
            ["sampled"],
            f""", binned as (select case when metered_savings < p0 then null
                when metered_savings <= p25 then 'Q1' when metered_savings <= p50 then 'Q2'
                when metered_savings <= p75 then 'Q3' when metered_savings <= p100 then 'Q4'
                end as bin
              from sampled, quartiles)
            select * from (values
              ('negatives', 'NEG', (select cast(count(*) as double) from sampled
                where metered_savings < 0)),
              {bins}, {breaks}) report(metric, label, value)""",
        ),
    }
