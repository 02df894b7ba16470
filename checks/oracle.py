"""SQL for the registered queries, for DuckDB on the given tables.

It states each result the plain way (as-of joins, range joins, window functions over whole keys), so the
two-level windows, time slots and running totals of the Spark side are checked against another form.
"""

from __future__ import annotations

import json
import re

from checks.lake import FILE_DAYS
from checks.registry import (
    AREA_MINUTES,
    AS_OF,
    BACKTEST_M,
    BOUNDARY,
    CITY_MINUTES,
    GAP_SECONDS,
    HOUR,
    PLAIN_STRATEGIES,
    SPANS,
)
from checks.streams import HORIZON, MAX_DELAY, STREAM_GAP_SECONDS, STREAM_WINDOW
from checks.tables import ORIGIN, RADIUS_M, TZ
from stationflow.operators.backtest import ORIGINS, STRATEGIES

LAT, LON = (f"{v}::double" for v in ORIGIN)


def metres(lat_a: str, lon_a: str, lat_b: str, lon_b: str) -> str:
    half = f"pow(sin(radians(({lat_b}) - ({lat_a})) / 2), 2)"
    side = f"cos(radians({lat_a})) * cos(radians({lat_b})) * pow(sin(radians(({lon_b}) - ({lon_a})) / 2), 2)"
    # least() skips NULL in this engine, so a NULL coordinate is passed on by the product
    return f"(12742000e0 * asin(sqrt(least(1e0, {half} + {side}))) * (({half} + {side}) * 0 + 1))"


def whole(expr: str) -> str:
    return f"cast(round({expr}) as integer)"


def wall(ts: str) -> str:
    return f"timezone('{TZ}', ({ts}) at time zone 'UTC')"


def hour(ts: str) -> str:
    return f"strftime({wall(ts)}, '%H:00')"


def clock(ts: str) -> str:
    return f"strftime({wall(ts)}, '%H:%M')"


def month(ts: str) -> str:
    return f"strftime({wall(ts)}, '%Y-%m')"


def big(expr: str) -> str:
    return f"cast({expr} as bigint)"


def yes(condition: str) -> str:
    """Share of rows where the condition holds."""
    return f"avg(cast(coalesce({condition}, false) as integer))"


ORIGIN_METRES = metres(LAT, LON, "lat", "lon")
S = SPANS

# Named subqueries; each may use the ones before it.
PARTS: dict[str, str] = {
    "ev": """select ts, date_trunc('hour', ts) as hour_ts, user_id, cast(user_id as varchar) as station_id, event_type,
        json_extract_string(props, '$.k') as bike_id,
        case when event_type = 'error' and value > 100 then null else cast(floor(value) as integer) % 4 end as bikes
        from events""",
    "station": """select cast(c_custkey as varchar) as station_id, c_name as name,
        'S-' || cast(c_custkey % 50 as varchar) as short_name,
        case when c_custkey % 29 = 0 then null else 49.15e0 + (c_custkey * 37 % 101) * 0.001e0 end as lat,
        case when c_custkey % 29 = 0 then null else 16.55e0 + (c_custkey * 53 % 97) * 0.001e0 end as lon,
        cast(c_nationkey as varchar) as region_id,
        cast(case when c_custkey % 17 = 0 then null else 4 + c_custkey % 8 end as integer) as capacity
        from customer where c_custkey in (select user_id from events)""",
    "info": """select * , timestamp '2024-01-15 00:00:00' as observed_at from station
        union all by name
        select * replace (lower(name) as name), timestamp '2024-01-01 00:00:00' as observed_at from station""",
    "newest_info": """select * exclude (observed_at) from info
        qualify row_number() over (partition by station_id order by observed_at desc) = 1""",
    "status": """select hour_ts as collected_at, station_id, arg_max(bikes, ts) as num_bikes_available,
        cast(floor(epoch(max(ts))) as bigint) as last_reported, bool_and(event_type <> 'error') as is_renting,
        bool_or(event_type = 'click') as is_returning,
        cast(case when user_id % 11 = 0 then null else 8 - coalesce(arg_max(bikes, ts), 0) end as integer)
            as num_docks_available
        from ev group by hour_ts, station_id, user_id""",
    "free": """select ts as collected_at, bike_id, case when event_type <> 'error' then station_id end as station_id,
        lat, lon from ev join station using (station_id)""",
    "free_hourly": """select hour_ts as collected_at, bike_id, case when event_type <> 'error' then station_id end
        as station_id from ev qualify row_number() over (partition by hour_ts, bike_id order by ts desc) = 1""",
    "runs": """select s.collected_at, s.n as station_count, s.b as bikes_available, coalesce(f.n, 0) as free_bike_count
        from (select collected_at, count(*) as n, cast(sum(coalesce(num_bikes_available, 0)) as bigint) as b
              from status group by 1) s
        left join (select collected_at, count(*) as n from free_hourly group by 1) f using (collected_at)""",
    "hourly_pair": """select *, lead(collected_at) over w as t, lead(station_id) over w as s,
        row_number() over (partition by bike_id order by collected_at desc) = 1 as final
        from free_hourly window w as (partition by bike_id order by collected_at)""",
    "minute_runs": """select date_trunc('minute', ts) as collected_at, count(*) as station_count,
        cast(sum(coalesce(bikes, 0)) as bigint) as bikes_available from ev group by 1""",
    "changes": """select ts as timestamp, station_id as nuid, name, lat as latitude, lon as longitude, bikes,
        case when event_type <> 'error' then bike_id end as listed from ev join station using (station_id)""",
    "now_rows": "select * from status where collected_at = (select max(collected_at) from runs)",
    "now_named": """select s.*, coalesce(i.name, s.station_id) as label, i.region_id, i.lat, i.lon
        from now_rows s left join newest_info i using (station_id)""",
    "gap": """select lag(collected_at) over (order by collected_at) as previous_collected_at, collected_at,
        date_diff('second', lag(collected_at) over (order by collected_at), collected_at) as gap_seconds
        from minute_runs""",
    "hour_gap": """select date_diff('second', lag(collected_at) over (order by collected_at), collected_at) as g
        from runs""",
    "live": f"""select station_id, label as name, region_id, num_bikes_available, lat, lon, {ORIGIN_METRES} as m
        from now_named where lat is not null and lon is not null""",
    "pool": f"""select station_id, name, region_id, num_bikes_available, {whole("m")} as distance_m, lat, lon from live
        where num_bikes_available > 0 order by distance_m, name, station_id limit 50""",
    # change log
    "catalog": """select nuid, arg_max(name, timestamp) as station_name, arg_max(latitude, timestamp) as latitude,
        arg_max(longitude, timestamp) as longitude from changes group by nuid""",
    "placed": f"""select *, {whole(metres(LAT, LON, "latitude", "longitude"))} as distance_m from catalog
        where latitude is not null and longitude is not null""",
    "near": f"select * from placed where distance_m <= {RADIUS_M}",
    "area_grid": f"""select unnest(generate_series((select min(timestamp) from changes),
        (select max(timestamp) from changes), interval '{AREA_MINUTES} minutes')) as sample_ts""",
    "area_sample": f"""select p.sample_ts, {month("p.sample_ts")} as local_month, {hour("p.sample_ts")} as local_hour,
        p.nuid, p.station_name, p.distance_m, c.bikes
        from (select * from area_grid, near) p asof left join changes c
        on p.nuid = c.nuid and p.sample_ts >= c.timestamp""",
    "hourly_grid": """select unnest(generate_series((select min(timestamp) from changes),
        (select max(timestamp) from changes), interval '60 minutes')) as sample_ts""",
    "hourly_sample": f"""select p.sample_ts, {hour("p.sample_ts")} as local_hour, p.nuid, p.station_name, c.bikes
        from (select * from hourly_grid, near) p asof left join changes c
        on p.nuid = c.nuid and p.sample_ts >= c.timestamp""",
    "area_state": """select sample_ts, local_month, local_hour, sum(coalesce(bikes, 0)) as total,
        count_if(coalesce(bikes, 0) > 0) as stocked from area_sample group by all""",
    "city_grid": f"""select unnest(generate_series((select min(timestamp) from changes),
        (select max(timestamp) from changes), interval '{CITY_MINUTES} minutes')) as sample_ts""",
    "span": """select nuid, timestamp as a, lead(timestamp, 1, timestamp '2999-01-01') over
        (partition by nuid order by timestamp) as b, bikes from changes""",
    "city_sample": f"""select sample_ts, {month("sample_ts")} as local_month, {hour("sample_ts")} as local_hour,
        nuid, bikes from city_grid join span on sample_ts >= a and sample_ts < b""",
    "city_state": """select sample_ts, local_month, local_hour, sum(bikes) as total, count(*) as observed,
        count_if(bikes > 0) as stocked, count_if(bikes = 0) as dry from city_sample group by all""",
    # vehicles
    "place": f"""select station_id, coalesce(name, station_id) as name, region_id, lat, lon,
        {whole(ORIGIN_METRES)} as distance_m from newest_info""",
    "seen": """select f.*, coalesce(p.name, f.station_id, 'free-floating') as station_name,
        p.distance_m as origin_distance_m from free f left join place p using (station_id)""",
    "obs": f"""select bike_id, collected_at, station_id, station_name, lat, lon, origin_distance_m,
        lag(collected_at) over w as previous_collected_at, lag(station_id) over w as previous_station_id,
        lag(station_name) over w as previous_station_name, lag(lat) over w as previous_lat,
        lag(lon) over w as previous_lon, lag(origin_distance_m) over w as previous_origin_distance_m,
        date_diff('minute', lag(collected_at) over w, collected_at) as window_minutes,
        {whole(metres("lag(lat) over w", "lag(lon) over w", "lat", "lon"))} as move_distance_m
        from seen window w as (partition by bike_id order by collected_at)""",
    "again": f"""select 'seen-again' as status, previous_collected_at as departed_after, collected_at as next_seen_at,
        {clock("previous_collected_at")} as local_departed_after, bike_id, previous_station_name as from_name,
        station_name as to_name, previous_station_id as from_station_id, station_id as to_station_id,
        previous_origin_distance_m as from_origin_distance_m, origin_distance_m as to_origin_distance_m,
        window_minutes, move_distance_m from obs where window_minutes <= 240""",
    "open_end": f"""select 'not-seen' as status, collected_at as departed_after, null::timestamp as next_seen_at,
        {clock("collected_at")} as local_departed_after, bike_id, station_name as from_name,
        'not seen again' as to_name, station_id as from_station_id, null::varchar as to_station_id,
        origin_distance_m as from_origin_distance_m, null::integer as to_origin_distance_m,
        date_diff('minute', collected_at, (select max(collected_at) from free)) as window_minutes,
        null::integer as move_distance_m
        from (select * from seen qualify row_number() over (partition by bike_id order by collected_at desc) = 1)
        where station_id is not null and origin_distance_m <= {RADIUS_M}
        and date_diff('minute', collected_at, (select max(collected_at) from free)) >= 3""",
    "touched": f"""select * from again where (from_station_id is distinct from to_station_id or move_distance_m >= 100)
        and least(coalesce(from_origin_distance_m, 1000000000), coalesce(to_origin_distance_m, 1000000000)) <= {RADIUS_M}
        union all select * from open_end""",
    "left_known": f"""select * from again where from_station_id is not null
        and from_station_id is distinct from to_station_id and from_origin_distance_m <= {RADIUS_M}""",
    "departed": "select * from left_known union all select * from open_end",
    # flows
    "uid": "select timestamp, nuid, listed as bike_uid from changes where listed is not null",
    "hop": f"""select u.*, p.station_name, p.latitude, p.longitude, p.distance_m,
        lag(u.timestamp) over w as prev_timestamp, lag(u.nuid) over w as prev_nuid,
        lag(p.station_name) over w as prev_name, lag(p.distance_m) over w as prev_distance_m,
        lag(p.latitude) over w as prev_latitude, lag(p.longitude) over w as prev_longitude
        from uid u join placed p using (nuid) window w as (partition by u.bike_uid order by u.timestamp)""",
    "flow": f"""select bike_uid, prev_timestamp, timestamp, prev_nuid, prev_name, prev_distance_m, nuid, station_name,
        distance_m, date_diff('minute', prev_timestamp, timestamp) as window_minutes,
        {whole(metres("prev_latitude", "prev_longitude", "latitude", "longitude"))} as move_m,
        {hour("prev_timestamp")} as local_hour, {month("prev_timestamp")} as local_month,
        prev_distance_m <= {RADIUS_M} as was_in, distance_m <= {RADIUS_M} as is_in
        from hop where nuid <> prev_nuid and date_diff('minute', prev_timestamp, timestamp) <= 720""",
    # area panel
    "near_place": f"select * from place where distance_m <= {RADIUS_M}",
    "panel": "select s.* from status s where station_id in (select station_id from near_place)",
    "panel_hour": f"""select {hour("collected_at")} as local_hour, count(*) as samples,
        round(avg(total), 2) as avg_total_bikes, round(avg(stocked), 2) as avg_stations_with_bikes,
        round(avg(dry), 2) as avg_empty_stations, round({yes("stocked = 0")}, 3) as all_empty_rate
        from (select collected_at, sum(num_bikes_available) as total, count_if(num_bikes_available > 0) as stocked,
              count_if(num_bikes_available = 0) as dry from panel group by 1) group by 1""",
    # features
    "base": f"""select station_id, collected_at, coalesce(num_bikes_available, 0) as bikes_now,
        coalesce(num_docks_available, 0) as docks_now, is_renting, is_returning,
        collected_at - interval '{S.short_lag} minutes' as t_short, collected_at - interval '{S.long_lag} minutes' as t_long,
        collected_at + interval '{S.horizon} minutes' as t_next from status""",
    "roll": f"""select b.station_id, b.collected_at, round(avg(r.bikes_now), 4) as bikes_avg_30m,
        round(avg(cast(r.bikes_now = 0 as integer)), 4) as empty_rate_30m, count(r.station_id) as samples_30m
        from base b left join base r on r.station_id = b.station_id and r.collected_at < b.collected_at
        and r.collected_at >= b.collected_at - interval '{S.rolling} minutes' group by 1, 2""",
    "looked": f"""select b.*, f.collected_at as tf, f.bikes_now as bf,
        case when l.collected_at >= b.t_short - interval '{S.lag_tolerance} minutes' then l.collected_at end as ts5,
        case when l.collected_at >= b.t_short - interval '{S.lag_tolerance} minutes' then l.bikes_now end as b5,
        case when m.collected_at >= b.t_long - interval '{S.lag_tolerance} minutes' then m.collected_at end as ts15,
        case when m.collected_at >= b.t_long - interval '{S.lag_tolerance} minutes' then m.bikes_now end as b15
        from base b
        asof left join base l on l.station_id = b.station_id and b.t_short >= l.collected_at
        asof left join base m on m.station_id = b.station_id and b.t_long >= m.collected_at
        asof left join base f on f.station_id = b.station_id and b.t_next <= f.collected_at""",
    "feature": """select k.station_id, i.name as station_name, i.short_name, i.region_id, i.lat, i.lon, i.capacity,
        k.collected_at, cast(extract(hour from k.collected_at) as integer) as hour,
        cast(extract(dow from k.collected_at) as integer) as weekday,
        extract(dow from k.collected_at) in (0, 6) as is_weekend, k.bikes_now, k.docks_now,
        k.bikes_now > 0 as has_bike_now, k.bikes_now = 0 as empty_now, k.is_renting, k.is_returning,
        k.b5 as bikes_lag_5m, date_diff('minute', k.ts5, k.collected_at) as minutes_since_lag_5m,
        k.b15 as bikes_lag_15m, date_diff('minute', k.ts15, k.collected_at) as minutes_since_lag_15m,
        k.bikes_now - k.b5 as bikes_delta_5m, k.bikes_now - k.b15 as bikes_delta_15m,
        round(case when i.capacity > 0 then k.bikes_now / cast(i.capacity as double) end, 4) as bikes_capacity_ratio,
        round(sin(2 * pi() * extract(hour from k.collected_at) / 24), 6) as hour_sin,
        round(cos(2 * pi() * extract(hour from k.collected_at) / 24), 6) as hour_cos,
        round(sin(2 * pi() * extract(dow from k.collected_at) / 7), 6) as weekday_sin,
        round(cos(2 * pi() * extract(dow from k.collected_at) / 7), 6) as weekday_cos,
        r.bikes_avg_30m, r.empty_rate_30m, r.samples_30m, k.tf, k.bf
        from looked k join roll r using (station_id, collected_at) left join newest_info i using (station_id)""",
    "ds": f"""select * exclude (tf, bf), tf as target_collected_at,
        date_diff('minute', collected_at, tf) as minutes_to_target, bf as bikes_future, bf > 0 as has_bike_future,
        bf = 0 as empty_future from feature where tf <= collected_at + interval '{S.last_target} minutes'""",
    # split, baselines
    "cut": """select collected_at as split_at from (select distinct collected_at from ds) order by collected_at
        limit 1 offset (select greatest(1, least(n - 1, cast(floor(n * 0.75e0) as bigint)))
                        from (select count(distinct collected_at) as n from ds))""",
    "train": "select * from ds where collected_at < (select split_at from cut)",
    "test": "select * from ds where collected_at >= (select split_at from cut)",
    "overall": "select avg(cast(empty_future as integer)) as rate from train",
    "prior": "select station_id, avg(cast(empty_future as integer)) as p from train group by 1",
    "test_p": """select t.*, coalesce(p.p, (select rate from overall)) as empty_probability
        from test t left join prior p using (station_id)""",
    "guess": """select 'majority_train_class' as model, station_id, collected_at, empty_future as y,
        (select rate from overall) >= 0.5 as y_hat, (select rate from overall) as score from test
        union all select 'persistence_empty_now', station_id, collected_at, empty_future, empty_now,
        cast(empty_now as double) from test
        union all select 'low_inventory_le_1', station_id, collected_at, empty_future, bikes_now <= 1,
        greatest(0e0, least(1e0, (2 - bikes_now) / 2e0)) from test
        union all select 'station_prior_empty_rate', station_id, collected_at, empty_future,
        empty_probability >= 0.5, empty_probability from test_p""",
    "level": """select model, score, count(*) as n, count_if(y) as p,
        sum(count(*)) over w as above_n, sum(count_if(y)) over w as above_p
        from guess group by model, score window w as (partition by model order by score desc)""",
    "curve": """select model, sum(p * above_p / cast(above_n as double)) / sum(p) as average_precision,
        sum((n - p) * (above_p - p / 2e0)) / (sum(p) * sum(n - p)) as roc_auc from level group by model""",
    "metric": """select model, avg(cast(y = y_hat as integer)) as accuracy,
        coalesce(count_if(y and y_hat) / cast(nullif(count_if(y_hat), 0) as double), 0) as precision,
        coalesce(count_if(y and y_hat) / cast(nullif(count_if(y), 0) as double), 0) as recall,
        coalesce(2 * count_if(y and y_hat) / cast(nullif(count_if(y) + count_if(y_hat), 0) as double), 0) as f1,
        roc_auc, average_precision, avg(cast(y_hat as integer)) as positive_rate
        from guess join curve using (model) group by model, roc_auc, average_precision""",
    # backtest
    "origin": "select * from (values "
    + ", ".join(f"('{n}', {a}::double, {b}::double)" for n, a, b in ORIGINS)
    + ") o(origin, o_lat, o_lon)",
    "cand": f"""select * from (select t.collected_at, o.origin, t.station_id, t.bikes_now, t.has_bike_future,
        t.empty_probability, {metres("o.o_lat", "o.o_lon", "t.lat", "t.lon")} as distance_m
        from test_p t, origin o where t.has_bike_now and t.lat is not null) where distance_m <= {BACKTEST_M}""",
    "offer": """select 'nearest_with_bike' as strategy, *, distance_m as score from cand
        union all select 'nearest_bikes_ge_2', *, distance_m from cand where bikes_now >= 2
        union all select 'nearest_model_low_risk', *, distance_m from cand where empty_probability < 0.4
        union all select 'distance_plus_risk_penalty', *, distance_m + empty_probability * 350 from cand""",
    "choice": f"""select s.strategy, a.collected_at, a.origin, c.station_id, c.has_bike_future as success, c.distance_m,
        c.empty_probability, c.distance_m - n.m as extra_distance_m, c.station_id is null as no_candidate
        from (select distinct collected_at, origin from test, origin) a
        cross join (values {", ".join(f"('{s}')" for s in STRATEGIES)}) s(strategy)
        left join (select * from offer qualify row_number() over
            (partition by strategy, collected_at, origin order by score, distance_m, station_id) = 1) c
            on c.strategy = s.strategy and c.collected_at = a.collected_at and c.origin = a.origin
        left join (select collected_at, origin, min(distance_m) as m from cand group by 1, 2) n
            on n.collected_at = a.collected_at and n.origin = a.origin""",
}


def _uses(name: str, text: str) -> bool:
    return re.search(rf"\b(from|join|,)\s+{name}\b|\bfrom \w+( \w+)?, {name}\b", text) is not None


def sql(text: str) -> str:
    """The statement with the named subqueries it needs in front."""
    needed: list[str] = []
    for name in reversed(PARTS):
        if any(_uses(name, body) for body in [text, *(PARTS[n] for n in needed)]):
            needed.append(name)
    parts = ",\n".join(f"{name} as ({PARTS[name]})" for name in reversed(needed))
    return f"with {parts}\n{text}" if parts else text


def _series(label: str, where: str = "true") -> str:
    return f"""select {label}, count(*) as samples, round(avg(total), 2) as avg_bikes,
        round(avg(stocked), 2) as avg_stations_with_bikes, round({yes("stocked = 0")}, 3) as all_empty_rate
        from area_state where {where} group by 1"""


def _matrix(row: str, rates: str, value: str) -> str:
    cells = ", ".join(
        f"coalesce(max({value}) filter (where local_hour = '{h:02d}:00'), 0) as \"{h:02d}:00\"" for h in range(24)
    )
    return f"select {row}, {cells} from ({rates}) group by 1"


_RISK = """case when num_bikes_available <= 0 then 'empty' when num_bikes_available = 1 then 'high'
    when num_bikes_available <= 3 then 'medium' when num_bikes_available > 3 then 'low' end as risk"""
_EVENT = """status, departed_after, next_seen_at, local_departed_after, bike_id, from_name, to_name, from_station_id,
    to_station_id, from_origin_distance_m, to_origin_distance_m, window_minutes, move_distance_m"""
_DIRECTION = f"""{big("count_if(was_in and not is_in)")} as outbound, {big("count_if(not was_in and is_in)")} as inbound,
    {big("count_if(was_in and is_in)")} as internal"""
_CITY_MONTH_HOUR = "select local_month, local_hour, round(avg(dry / observed), 3) as empty_station_rate from city_state group by 1, 2"
_STATION_HOUR = f"""select station_name, local_hour, round({yes("coalesce(bikes, 0) = 0")}, 3) as empty_rate
    from area_sample group by 1, 2"""
_CITY_RATES = f"""select c.nuid, p.station_name, p.latitude, p.longitude, count(*) as samples,
    round(avg(bikes), 3) as avg_bikes, round({yes("bikes = 0")}, 3) as empty_rate,
    round({yes("bikes <= 1")}, 3) as low_rate from city_sample c join catalog p using (nuid) group by all"""
_REACHED = """select nuid, station_name, distance_m, count(*) as moves,
    round(avg(window_minutes), 1) as avg_window_minutes, round(avg(move_m), 0) as avg_move_m
    from flow where was_in and not is_in group by 1, 2, 3 order by moves desc, station_name, nuid"""
_RUN_TOTALS = "from runs where collected_at >= timestamp '2000-01-01'"


def _health(where: str) -> str:
    return f"""select count(*) as runs, min(collected_at) as first_collected_at, max(collected_at) as latest_collected_at,
        min(station_count) as min_station_count, round(avg(station_count), 2) as avg_station_count,
        max(station_count) as max_station_count, min(bikes_available) as min_bikes_available,
        round(avg(bikes_available), 2) as avg_bikes_available, max(bikes_available) as max_bikes_available,
        count(*) - count(distinct collected_at) as duplicate_collected_at,
        {big("floor(epoch(max(collected_at) - min(collected_at)) / 3600)")} + 1 as expected_samples,
        round(count(*) / (floor(epoch(max(collected_at) - min(collected_at)) / 3600) + 1) * 100, 2) as coverage_pct,
        (select count(*) from status where {where}) as station_rows,
        (select count(distinct station_id) from status where {where}) as distinct_stations,
        (select count(*) from free_hourly where {where}) as free_bike_rows,
        {big("count_if(g > 3600)")} as gap_count, max(g) as max_gap_seconds,
        round(avg(g), 2) as avg_interval_seconds, min(g) as min_interval_seconds
        from (select *, date_diff('second', lag(collected_at) over (order by collected_at), collected_at) as g
              from runs where {where})"""


_SCORED = f"""select station_id, name, bikes, distance_m,
    case when distance_m <= 600 then 'local' else 'fallback' end as tier, hist_avg_bikes, hist_empty_rate, hour_empty_rate,
    round(distance_m + coalesce(hour_empty_rate, 0.5) * 900 + coalesce(hist_low_rate, hour_empty_rate, 0.5) * 400
        - least(bikes, 5) * 140 + case when bikes <= 0 then 5000 else 0 end, 6) as score,
    case when bikes <= 0 then 'empty now' when bikes = 1 then 'last bike' when hour_empty_rate is null then 'live ok'
        when hour_empty_rate <= 0.15 then 'best' when hour_empty_rate <= 0.35 then 'good'
        when hour_empty_rate <= 0.55 then 'watch' else 'risky' end as recommendation"""


def _scored(max_walk: int, history: bool) -> str:
    rates = (
        """left join (select nuid as station_id, round(avg(coalesce(bikes, 0)), 2) as hist_avg_bikes,
            round(avg(cast(coalesce(bikes, 0) = 0 as integer)), 3) as hist_empty_rate,
            round(avg(cast(coalesce(bikes, 0) <= 1 as integer)), 3) as hist_low_rate,
            round(avg(cast(coalesce(bikes, 0) = 0 as integer)) filter (where local_hour = '%s'), 3) as h
            from hourly_sample group by 1) using (station_id)"""
        % HOUR
        if history
        else """cross join (select null::double as hist_avg_bikes, null::double as hist_empty_rate,
            null::double as hist_low_rate, null::double as h)"""
    )
    return f"""{_SCORED} from (select station_id, name, coalesce(num_bikes_available, 0) as bikes,
        {whole("m")} as distance_m, hist_avg_bikes, hist_empty_rate, hist_low_rate,
        coalesce(h, hist_empty_rate) as hour_empty_rate from live {rates} where m <= {max_walk})"""


def _ring_edges() -> str:
    rows = []
    for poly, rings in enumerate(json.loads(BOUNDARY)["coordinates"]):
        for ring, points in enumerate(rings):
            before = points[-1:] + points[:-1]
            rows += [f"({poly}, {ring}, {a[0]}::double, {a[1]}::double, {b[0]}::double, {b[1]}::double)" for a, b in zip(before, points)]
    return f"(values {', '.join(rows)}) e(poly, ring, x1, y1, x2, y2)"


def _geofence() -> str:
    return f"""select i.* from newest_info i where station_id in (
        select station_id from (
            select station_id, poly, ring, count_if((y2 > lat) <> (y1 > lat)
                and lon < (x1 - x2) * (lat - y2) / nullif(y1 - y2, 0) + x2) % 2 = 1 as odd
            from newest_info, {_ring_edges()} where lat is not null group by 1, 2, 3)
        group by station_id, poly having bool_or(odd and ring = 0) and not coalesce(bool_or(odd) filter (where ring > 0), false))"""


_FRAME = """select *, a - greatest((b - a) * 0.08e0, 0.001e0) as la, b + greatest((b - a) * 0.08e0, 0.001e0) as lb,
    c - greatest((d - c) * 0.08e0, 0.001e0) as oa, d + greatest((d - c) * 0.08e0, 0.001e0) as ob
    from (select *, min(lat) over () as a, max(lat) over () as b, min(lon) over () as c, max(lon) over () as d
          from pts where lat is not null and lon is not null)"""


def _grid() -> str:
    at = [("(lon - oa) / (ob - oa) * 57", 57, "x"), ("(lb - lat) / (lb - la) * 21", 21, "y")]
    cells = ", ".join(f"cast(least({top}, greatest(0, round_even({e}, 0))) as integer) as {n}" for e, top, n in at)
    return f"""select x, y, count(*) as points, bool_or(bikes > 0) as any_bikes,
        case when count(*) > 1 then '*' else '.' end as symbol from (select {cells}, bikes from (
        with pts as (select i.*, s.num_bikes_available as bikes from newest_info i join (select * from status
            qualify row_number() over (partition by station_id order by collected_at desc) = 1) s using (station_id))
        {_FRAME})) group by 1, 2"""


def _band() -> str:
    core = max(2.4, 22 * 0.14)
    return f"""select x, y, case when d <= {core}::double then 'core' else 'edge' end as band from (
        select x, y, min(sqrt(pow(x - px, 2) + pow(y - py, 2))) as d from
        (select cast(range as integer) as x from range(58)), (select cast(range as integer) as y from range(22)),
        (select (lon - oa) / (ob - oa) * 57 as px, (lb - lat) / (lb - la) * 21 as py from (
            with pts as (select * from now_named) {_FRAME}))
        group by 1, 2) where d <= {core}::double + 1.7e0"""


def statements() -> dict[str, str]:
    rounded_metric = ", ".join(
        f"round({c}, 6) as {c}"
        for c in "accuracy precision recall f1 roc_auc average_precision positive_rate".split()
    )
    split_facts = """(select split_at from cut) as split_collected_at, (select count(*) from train) as train_rows,
        (select count(*) from test) as test_rows, (select min(collected_at) from train) as train_from,
        (select min(collected_at) from test) as test_from, (select max(collected_at) from train) as train_to,
        (select max(collected_at) from test) as test_to"""
    since = f"timestamp '{AS_OF}' - interval '12030 minutes'"
    nearest = f"""select station_id, name, region_id, num_bikes_available, {_RISK}, {whole("m")} as distance_m, lat, lon
        from live"""
    near_order = "order by distance_m, name, station_id limit 10"
    features = """station_id, region_id, hour, weekday, is_weekend, bikes_now, docks_now, has_bike_now, empty_now,
        is_renting, is_returning, bikes_lag_5m, minutes_since_lag_5m, bikes_lag_15m, minutes_since_lag_15m,
        bikes_delta_5m, bikes_delta_15m, bikes_capacity_ratio, hour_sin, hour_cos, weekday_sin, weekday_cos,
        bikes_avg_30m, empty_rate_30m, samples_30m, capacity, lat, lon"""
    rounded_places = "round(lat, 6) as lat, round(lon, 6) as lon"
    per_hour = """count(*) as departures, count(distinct bike_id) as bikes,
        cast(count_if(status = 'seen-again') as bigint) as known_destinations,
        cast(count_if(status = 'not-seen') as bigint) as open_departures"""
    return {
        "normalize_status": f"select collected_at, {_FEED_TIME}, {_STATUS_ROW} from status",
        "normalize_info": f"select collected_at as observed_at, {_FEED_TIME}, {_INFO_ROW} from status join station using (station_id)",
        "normalize_free_bikes": f"select collected_at, {_FEED_TIME}, {_BIKE_ROW} from free_hourly",
        "run_rows": f"select strftime(collected_at, 'raw/%Y/%m/%d/%Y%m%dT%H%M%SZ.json') as raw_path, {_RUN_ROW} from runs",
        "collection_runs": "select * from runs",
        "latest_station_info": "select * from newest_info",
        "db_stats": f"""select count(*) as runs, min(collected_at) as first_collected_at,
            max(collected_at) as latest_collected_at, {big("sum(station_count)")} as station_status_rows,
            max(station_count) as max_station_count, max(bikes_available) as max_bikes_available,
            (select count(distinct station_id) from status) as distinct_stations,
            arg_max(station_count, collected_at) as latest_station_count,
            arg_max(bikes_available, collected_at) as latest_bikes_available,
            arg_max(free_bike_count, collected_at) as latest_free_bike_count {_RUN_TOTALS}""",
        "db_summary": f"""select count(*) as collection_runs, min(collected_at) as first_collected_at,
            max(collected_at) as latest_collected_at, {big("sum(station_count)")} as station_rows,
            {big("sum(free_bike_count)")} as free_bike_rows, min(bikes_available) as min_bikes_available,
            round(avg(bikes_available), 2) as avg_bikes_available, max(bikes_available) as max_bikes_available,
            (select count(distinct station_id) from status) as distinct_stations {_RUN_TOTALS}""",
        "latest_snapshot": f"""select r.*, {big("count_if(s.num_bikes_available = 0)")} as empty_stations,
            {big("count_if(s.num_bikes_available > 0)")} as stations_with_bikes,
            round(avg(s.num_bikes_available), 2) as avg_bikes_per_station,
            max(s.num_bikes_available) as max_bikes_at_station
            from runs r join now_rows s using (collected_at) group by all""",
        "freshness": f"""select *, cast(floor(epoch(timestamp '{AS_OF}' - collected_at)) as bigint)
            as seconds_since_latest,
            (select count(*) from free_hourly where collected_at = (select max(collected_at) from runs))
            as latest_free_bike_rows from runs order by collected_at desc limit 1""",
        "data_health": _health("true"),
        "data_health_recent": _health(f"collected_at >= {since}"),
        "gap_summary": f"""select {big(f"count_if(gap_seconds > {GAP_SECONDS})")} as gap_count,
            max(gap_seconds) as max_gap_seconds, round(avg(gap_seconds), 2) as avg_interval_seconds,
            min(gap_seconds) as min_interval_seconds from gap where previous_collected_at is not null""",
        "data_gaps": f"""select * from gap where gap_seconds > {GAP_SECONDS}
            order by gap_seconds desc, collected_at desc limit 10""",
        "system_trend": f"""select r.collected_at, r.bikes_available, r.free_bike_count,
            {big("count_if(s.num_bikes_available = 0)")} as empty_stations,
            round(avg(s.num_bikes_available), 2) as avg_bikes_per_station,
            max(s.num_bikes_available) as max_bikes_at_station
            from runs r join status s using (collected_at) group by 1, 2, 3 order by 1 desc limit 20""",
        "top_stations_latest": """select station_id, label as name, region_id, num_bikes_available,
            num_docks_available, last_reported from now_named
            order by num_bikes_available desc nulls last, label, station_id limit 15""",
        "top_stations_avg": """select s.station_id, coalesce(i.name, s.station_id) as name, i.region_id,
            round(avg(num_bikes_available), 2) as avg_bikes_available,
            max(num_bikes_available) as max_bikes_available, count(*) as samples
            from status s left join newest_info i using (station_id) group by 1, 2, 3
            order by avg_bikes_available desc nulls last, name, station_id limit 15""",
        "empty_stations_latest": """select station_id, label as name, region_id, last_reported from now_named
            where num_bikes_available = 0 order by label, station_id limit 30""",
        "empty_stations_rate": f"""select s.station_id, coalesce(i.name, s.station_id) as name, i.region_id,
            round({yes("num_bikes_available = 0")}, 3) as empty_rate, count(*) as samples,
            round(avg(num_bikes_available), 2) as avg_bikes_available
            from status s left join newest_info i using (station_id) group by 1, 2, 3
            order by empty_rate desc, samples desc, name, station_id limit 30""",
        "station_search": """select station_id, name, short_name, region_id, lat, lon from newest_info
            where station_id = 's-1' or lower(name) like '%s-1%' or lower(short_name) like '%s-1%'
            order by station_id = 's-1' desc, name, station_id limit 25""",
        "station_latest": f"""select collected_at, station_id, num_bikes_available, num_docks_available, is_renting,
            is_returning, last_reported, {_RISK} from status
            qualify row_number() over (partition by station_id order by collected_at desc) = 1""",
        "station_profile": f"""select station_id, count(*) as samples, round(avg(num_bikes_available), 2) as avg_bikes,
            min(num_bikes_available) as min_bikes, max(num_bikes_available) as max_bikes,
            round({yes("num_bikes_available = 0")}, 3) as empty_rate from status group by 1""",
        "station_recent": f"""select station_id, collected_at, num_bikes_available, {_RISK}, num_docks_available,
            is_renting, is_returning from status
            qualify row_number() over (partition by station_id order by collected_at desc) <= 20""",
        "station_map_summary": f"""select collected_at, count(*) as station_count,
            {big("sum(coalesce(num_bikes_available, 0))")} as bikes_available,
            {big("count_if(coalesce(num_bikes_available, 0) = 0)")} as empty_stations from now_rows group by 1""",
        "station_map_points": """select station_id, label as name, region_id, lat, lon,
            coalesce(num_bikes_available, 0) as bikes, num_docks_available as docks from now_named
            where lat is not null and lon is not null""",
        "station_map_stocked": """select station_id, label as name, region_id, lat, lon, num_bikes_available as bikes,
            num_docks_available as docks from now_named
            where lat is not null and lon is not null and num_bikes_available > 0""",
        "nearest_stations": f"{nearest} where num_bikes_available > 0 {near_order}",
        "nearest_within": f"{nearest} where m <= 2500 {near_order}",
        "nearest_reliable": f"""select *, {_RISK} from (select *, false as fallback,
            distance_m - min(distance_m) over () as extra_distance_m from pool)
            where num_bikes_available >= 2 order by distance_m, name, station_id limit 5""",
        "nearest_reliable_fallback": f"""select *, {_RISK} from (select *, true as fallback,
            distance_m - min(distance_m) over () as extra_distance_m from pool)
            order by distance_m, name, station_id limit 5""",
        "nearest_with_risk": f"""select n.*, empty_probability,
            case when empty_probability >= 0.7 then 'high' when empty_probability >= 0.4 then 'medium' else 'low' end
            as risk_label, case when empty_probability >= 0.7 then 'risky' when empty_probability >= 0.4 then 'watch'
            else 'safe' end as advice from ({nearest} where num_bikes_available > 0 {near_order}) n
            join (select station_id, round({yes("num_bikes_available = 0")}, 3) as empty_probability
                  from status group by 1) using (station_id)""",
        "station_history_rates": f"""select nuid as station_id, station_name,
            round(avg(coalesce(bikes, 0)), 2) as hist_avg_bikes,
            round({yes("coalesce(bikes, 0) = 0")}, 3) as hist_empty_rate,
            round({yes("coalesce(bikes, 0) <= 1")}, 3) as hist_low_rate,
            round({yes("coalesce(bikes, 0) = 0")} filter (where local_hour = '{HOUR}'), 3) as hour_empty_rate
            from hourly_sample group by 1, 2""",
        "strategy_ranking": f"{_scored(1600, True)} order by score, distance_m, name, station_id limit 12",
        "strategy_ranking_live_only": f"{_scored(3000, False)} order by score, distance_m, name, station_id limit 12",
        "strategy_best": f"""select b.station_id as best_station_id, b.name as best_name, b.bikes as best_bikes,
            b.distance_m as best_distance_m, l.station_id as local_station_id, l.name as local_name,
            l.bikes as local_bikes, l.distance_m as local_distance_m,
            b.station_id is not null and l.station_id is null as uses_fallback
            from (select 1 as k) left join (select 1 as k, * from ({_scored(1600, True)}) where bikes > 0
                order by score, distance_m, name, station_id limit 1) b using (k)
            left join (select 1 as k, * from ({_scored(1600, True)}) where bikes > 0 and tier = 'local'
                order by score, distance_m, name, station_id limit 1) l using (k)""",
        "geofence_filter": _geofence(),
        "grid_bin": _grid(),
        "footprint_band": _band(),
        "area_coverage": """select min(collected_at) as first_collected, max(collected_at) as latest_collected,
            count(distinct collected_at) as snapshots, count(*) as station_rows,
            count(distinct station_id) as stations from panel""",
        "area_latest": f"""select {big("sum(num_bikes_available)")} as total_bikes,
            {big("count_if(num_bikes_available > 0)")} as stations_with_bikes,
            {big("count_if(num_bikes_available = 0)")} as empty_stations from panel
            where collected_at = (select max(collected_at) from status)""",
        "area_stations": f"""select p.station_id, p.name, coalesce(l.num_bikes_available, 0) as latest_bikes,
            p.distance_m, coalesce(avg_bikes, 0) as avg_bikes, coalesce(empty_rate, 0) as empty_rate,
            coalesce(low_rate, 0) as low_rate, coalesce(samples, 0) as samples from near_place p
            left join (select * from status where collected_at = (select max(collected_at) from status)) l
                using (station_id)
            left join (select station_id, count(*) as samples, round(avg(num_bikes_available), 2) as avg_bikes,
                round({yes("num_bikes_available = 0")}, 3) as empty_rate,
                round({yes("num_bikes_available <= 1")}, 3) as low_rate from panel group by 1) using (station_id)
            order by distance_m, p.name, station_id limit 12""",
        "area_hourly": "select * from panel_hour",
        "depletion_by_hour": f"""select {hour("collected_at")} as local_hour, count(*) as depletion_events from (
            select collected_at, num_bikes_available as n,
                lag(num_bikes_available) over (partition by station_id order by collected_at) as b from panel)
            where b > 0 and n = 0 group by 1""",
        "area_morning_signals": """select
            coalesce(min(local_hour) filter (where avg_total_bikes <= 1), 'not observed') as first_low_hour,
            coalesce(min(local_hour) filter (where all_empty_rate > 0), 'not observed') as first_all_empty_hour,
            coalesce(min(local_hour) filter (where all_empty_rate >= 1), 'not observed') as first_fully_empty_hour
            from panel_hour where local_hour between '05:00' and '12:00'""",
        "bike_observations": "select * from obs",
        "bike_moves": "select * from obs where previous_collected_at is not null",
        "move_events": f"select {_EVENT} from touched order by departed_after desc, bike_id, status limit 30",
        "move_events_all": f"select {_EVENT} from touched",
        "move_summary": """select count(*) as moves, count(distinct bike_id) as bikes,
            cast(count_if(status = 'seen-again') as bigint) as known_destination_moves,
            cast(count_if(status = 'not-seen') as bigint) as open_departures,
            min(departed_after) as first_move, max(departed_after) as latest_move from touched""",
        "departures": f"select {_EVENT} from departed order by departed_after desc, bike_id, status limit 30",
        "departures_all": f"select {_EVENT} from departed",
        "departures_hourly": f"""select {hour("departed_after")} as local_hour, {per_hour},
            round(avg(window_minutes), 1) as avg_window_minutes from departed group by 1""",
        "departure_destinations": """select from_name, to_name, count(*) as departures,
            round(avg(window_minutes), 1) as avg_window_minutes,
            round(avg(move_distance_m), 0) as avg_move_distance_m from left_known group by 1, 2
            order by departures desc, from_name, to_name limit 30""",
        "departure_summary": f"""select {per_hour}, count(distinct from_station_id) as origin_stations,
            min(departed_after) as first_departure, max(departed_after) as latest_departure from departed""",
        "history_summary": """select count(*) as row_count, min(timestamp) as first_timestamp,
            max(timestamp) as latest_timestamp, count(distinct nuid) as station_ids,
            count(distinct name) as station_names, strftime(min(timestamp), '%Y%m') as first_month,
            strftime(max(timestamp), '%Y%m') as latest_month from changes""",
        "history_monthly": f"""select strftime(timestamp, '%Y%m') as month_key, count(*) as change_rows,
            count(distinct nuid) as station_ids, round(avg(bikes), 2) as avg_bikes_on_change,
            {big("count_if(bikes = 0)")} as empty_change_rows from changes group by 1""",
        "station_latest_position": "select * from catalog",
        "stations_in_radius": "select nuid, station_name, distance_m from near",
        "sample_area_asof": "select * from area_sample",
        "area_history_summary": f"""select count(*) as samples, min(sample_ts) as first_sample,
            max(sample_ts) as latest_sample, round(avg(total), 2) as avg_bikes,
            round(avg(stocked), 2) as avg_stations_with_bikes, round({yes("stocked = 0")}, 3) as all_empty_rate
            from area_state""",
        "area_history_hourly": _series("local_hour", "local_hour between '04:00' and '12:00'"),
        "local_hourly": _series("local_hour"),
        "area_history_morning": _series("local_month", "local_hour between '06:00' and '10:00'"),
        "area_station_rates": f"""select nuid, station_name, distance_m, count(*) as samples,
            round(avg(coalesce(bikes, 0)), 2) as avg_bikes, round({yes("coalesce(bikes, 0) = 0")}, 3) as empty_rate,
            round({yes("coalesce(bikes, 0) <= 1")}, 3) as low_rate from area_sample group by 1, 2, 3""",
        "station_hour_rates": _STATION_HOUR,
        "station_hour_matrix": _matrix("station_name", _STATION_HOUR, "empty_rate"),
        "sample_city_interval": """select s.sample_ts, s.local_month, s.local_hour, s.nuid, c.station_name, c.latitude,
            c.longitude, s.bikes from city_sample s join catalog c using (nuid)""",
        "city_monthly": """select local_month, count(*) as samples, round(avg(total), 2) as avg_total_bikes,
            round(avg(total / observed), 3) as avg_bikes_per_station,
            round(avg(stocked), 2) as avg_stations_with_bikes,
            round(avg(dry / observed), 3) as empty_station_rate from city_state group by 1""",
        "city_hourly": """select local_hour, count(*) as samples, round(avg(total / observed), 3)
            as avg_bikes_per_station, round(avg(dry / observed), 3) as empty_station_rate from city_state group by 1""",
        "city_month_hour": _CITY_MONTH_HOUR,
        "city_month_hour_matrix": _matrix("local_month", _CITY_MONTH_HOUR, "empty_station_rate"),
        "city_station_rates": _CITY_RATES,
        "emptiest_stations": f"{_CITY_RATES} order by empty_rate desc, nuid limit 15",
        "station_hour_percent": f"select *, round(empty_rate * 100, 6) as empty_rate_pct from ({_STATION_HOUR})",
        "station_map_table": f"select *, nuid in (select nuid from near) as is_local from ({_CITY_RATES})",
        "worst_months": _series("local_month", "local_hour between '06:00' and '10:00'")
        + " order by all_empty_rate desc, local_month limit 5",
        "bike_uid_events": "select * from uid",
        "flow_changes": "select * exclude (was_in, is_in) from flow",
        "flow_hourly": f"select *, outbound - inbound as net_outbound from (select local_hour, {_DIRECTION} from flow group by 1)",
        "flow_monthly": f"select *, outbound - inbound as net_outbound from (select local_month, {_DIRECTION} from flow group by 1)",
        "flow_destinations": f"{_REACHED} limit 20",
        "flow_destinations_head": f"{_REACHED} limit 12",
        "flow_origins": """select prev_nuid as nuid, prev_name as station_name, prev_distance_m as distance_m,
            count(*) as outbound from flow where was_in and not is_in group by 1, 2, 3""",
        "flow_summary": f"""select count(*) as all_city_moves, {_DIRECTION}, count(distinct bike_uid) as bikes from flow""",
        "morning_flow_totals": f"""select {big("sum(outbound)")} as morning_out, {big("sum(inbound)")} as morning_in
            from (select local_hour, {_DIRECTION} from flow group by 1) where local_hour between '05:00' and '10:00'""",
        "availability_dataset": f"select * replace ({rounded_places}) from ds",
        "dataset_summary": f"""select count(*) as rows, count(distinct station_id) as stations,
            min(collected_at) as first_collected_at, max(collected_at) as latest_collected_at,
            {big("count_if(bikes_lag_5m is null)")} as null_lag_5m,
            {big("count_if(bikes_lag_15m is null)")} as null_lag_15m,
            round({yes("has_bike_future")}, 4) as positive_rate, round({yes("empty_future")}, 4) as empty_future_rate,
            round(avg(minutes_to_target), 2) as avg_minutes_to_target from ds""",
        "dataset_change_stats": f"""select count(*) as rows, count(distinct station_id) as stations,
            min(collected_at) as first_collected_at, max(collected_at) as latest_collected_at,
            round({yes("empty_future")}, 4) as empty_future_rate,
            round(avg(abs(bikes_future - bikes_now)), 4) as avg_abs_change,
            round({yes("bikes_future <> bikes_now")}, 4) as changed_rate,
            {big("count_if(bikes_lag_5m is null)")} as null_lag_5m,
            {big("count_if(bikes_lag_15m is null)")} as null_lag_15m from ds""",
        "latest_features": f"""select * replace ({rounded_places}) from (select {features} from feature
            where collected_at = (select max(collected_at) from runs))""",
        "temporal_split": f"select {split_facts}",
        "baseline_predictions": "select * replace (round(score, 6) as score) from guess",
        "binary_metrics": f"select model, {rounded_metric} from metric",
        "evaluation_result": f"select model, {rounded_metric}, {split_facts} from metric",
        "best_model_comparison": """select b.model as best_baseline, round(b.f1, 6) as baseline_f1, m.model as best_model,
            round(m.f1, 6) as model_f1, round(m.f1 - b.f1, 6) as f1_delta,
            case when m.f1 - b.f1 > 0.002 then 'model ahead' when m.f1 - b.f1 < -0.002 then 'baseline ahead'
            else 'tied' end as verdict
            from (select model, f1 from metric where model in ('majority_train_class', 'persistence_empty_now')
                  order by f1 desc, model desc limit 1) b,
                 (select model, f1 from metric where model not in ('majority_train_class', 'persistence_empty_now')
                  order by f1 desc, model desc limit 1) m""",
        "recommendation_choices": """select * replace (round(distance_m, 6) as distance_m,
            round(empty_probability, 6) as empty_probability, round(extra_distance_m, 6) as extra_distance_m)
            from choice""",
        "recommendation_metrics": """select strategy, case strategy """
        + " ".join(f"when '{k}' then '{v}'" for k, v in STRATEGIES.items())
        + """ end as label, count(*) as attempts, cast(count_if(no_candidate) as bigint) as no_candidate,
            round(avg(cast(success as integer)), 6) as success_rate, round(avg(distance_m), 6) as avg_distance_m,
            round(quantile_cont(distance_m, 0.9), 6) as p90_distance_m,
            round(avg(empty_probability), 6) as avg_empty_probability,
            round(avg(extra_distance_m), 6) as avg_extra_distance_m from choice group by 1""",
    }


def file_statements() -> dict[str, str]:
    """Files of five days: every fourth one is new at the second taking, and those that lacked stations have changed."""
    return {
        "history_pickup": f"""select number, case when n % 4 = 3 or (n % 2 = 0 and lacking > 0) then 2 else 1 end as version,
            cast(rows as bigint) as rows, cast(stations as bigint) as stations, cast(bikes as bigint) as bikes from (
            select cast(n as varchar) as number, n, count(*) as rows, count(distinct nuid) as stations, sum(bikes) as bikes,
                count_if(cast(nuid as bigint) % 3 = 0) as lacking
            from (select *, cast(floor(epoch(timestamp) / {FILE_DAYS * 86400}) as bigint) % 100 + 202300 as n from changes) group by n)""",
        "kept_table": "select *, cast(collected_at as date) as day from runs",
    }


def model_statements() -> dict[str, str]:
    """What is known of the trained models without training one."""
    facts = f"""select m.model, a.train_rows, a.train_positives, b.test_rows, b.test_positives, true as scores_in_range,
        true as calls_follow_scores, true as metrics_agree
        from (values ('%s')) m(model),
        (select count(*) as train_rows, {big("count_if(empty_future)")} as train_positives from train) a,
        (select count(*) as test_rows, {big("count_if(empty_future)")} as test_positives from test) b"""
    plain = f"strategy in {PLAIN_STRATEGIES}"
    labels = " ".join(f"when '{k}' then '{v}'" for k, v in STRATEGIES.items())
    return {
        "train_logistic": facts % "logistic_regression",
        "train_boosted_trees": facts % "boosted_trees",
        "predict_latest_risk": "select station_id, true as label_follows from now_named",
        "nearest_with_trained_risk": f"""select station_id, name, num_bikes_available, {whole("m")} as distance_m, true as label_follows
            from live where num_bikes_available > 0 and m is not null order by distance_m, name, station_id limit 10""",
        "trained_comparison": """select model as best_baseline, round(f1, 6) as baseline_f1, true as model_known,
            true as verdict_follows from metric order by f1 desc, model desc limit 1""",
        "trained_choices": f"""select strategy, collected_at, origin, case when {plain} then station_id end as station_id,
            case when {plain} then success end as success, case when {plain} then no_candidate end as no_candidate,
            true as keeps_rule from choice""",
        "trained_choice_metrics": f"""select strategy, case strategy {labels} end as label, count(*) as attempts,
            case when {plain} then cast(count_if(no_candidate) as bigint) end as no_candidate,
            case when {plain} then round(avg(cast(success as integer)), 6) end as success_rate,
            case when {plain} then round(avg(distance_m), 6) end as avg_distance_m,
            case when {plain} then round(quantile_cont(distance_m, 0.9), 6) end as p90_distance_m,
            case when {plain} then round(avg(extra_distance_m), 6) end as avg_extra_distance_m,
            true as probability_in_range from choice group by 1""",
    }


_FEED_TIME = "cast(epoch(collected_at) as bigint) as feed_last_updated"
_N = "cast(station_id as bigint)"
_K = "cast(bike_id as bigint)"
_STATUS_ROW = f"""station_id, num_bikes_available, num_docks_available, {_N} % 13 <> 0 as is_installed, is_renting, is_returning, last_reported,
    case when {_N} % 3 = 0 then case when num_bikes_available is null then '[{{"vehicle_type_id":"bike"}}]'
    else '[{{"vehicle_type_id":"bike","count":' || num_bikes_available || '}}]' end else '[]' end as vehicle_types_available"""
_INFO_ROW = f"""station_id, name, short_name, lat, lon, region_id,
    case when {_N} % 7 <> 0 then {_N} % 19 = 0 end as is_virtual_station, capacity"""
_BIKE_ROW = f"""bike_id, {_K} % 5 = 0 as is_reserved, case when {_K} % 11 <> 0 then {_K} % 7 = 0 end as is_disabled,
    49 + ({_K} % 100) * 0.001e0 as lat, 16 + ({_K} % 90) * 0.001e0 as lon, 'type-' || {_K} % 3 as vehicle_type_id, station_id,
    case when {_K} % 2 = 0 then 'plan-' || {_K} % 4 end as pricing_plan_id,
    case when {_K} % 4 = 0 then '{{"ios":"app://' || bike_id || '"}}' else '{{}}' end as rental_uris"""
_RUN_ROW = """collected_at, cast(station_count as integer) as station_count, cast(bikes_available as integer) as bikes_available,
    cast(free_bike_count as integer) as free_bike_count"""


def stream_statements() -> dict[str, str]:
    """What a stream must give out once all snapshots have landed; the marker snapshot is never passed."""
    return {
        "stream_runs": f"""select collected_at, count(*) as station_count,
            {big("sum(coalesce(num_bikes_available, 0))")} as bikes_available,
            {big("count_if(num_bikes_available = 0)")} as empty_stations,
            round(avg(num_bikes_available), 2) as avg_bikes_per_station,
            max(num_bikes_available) as max_bikes_at_station from status group by 1""",
        "stream_deduplicated": f"select collected_at, {_FEED_TIME}, {_STATUS_ROW} from status",
        "ingest_status": f"select collected_at, {_FEED_TIME}, {_STATUS_ROW} from status",
        "ingest_info": f"select collected_at as observed_at, {_FEED_TIME}, {_INFO_ROW} from status join station using (station_id)",
        "ingest_free_bikes": f"select collected_at, {_FEED_TIME}, {_BIKE_ROW} from free_hourly",
        "ingest_runs": f"select {_RUN_ROW} from runs",
        "ingest_rejected": """select distinct feed, reason, case when reason = 'no id' then t end as collected_at,
            case reason when 'no id' then '{"num_docks_available":7}' when 'no time' then '{"feeds":{}}'
            else '{"collected_at": "' || strftime(t, '%Y-%m-%d') end as document
            from (select distinct collected_at as t from (select collected_at from status union all
                select collected_at from free_hourly) where hour(collected_at) = 6),
            (values ('station_status', 'no id'), ('document', 'unreadable'), ('document', 'no time')) as k(feed, reason)""",
        "stream_depletions": """select station_id, collected_at from (select station_id, collected_at,
            num_bikes_available as n, lag(num_bikes_available) over (partition by station_id order by collected_at) as b
            from status) where b > 0 and n = 0""",
        "stream_departures": f"""select 'not-seen' as status, bike_id, collected_at as departed_after, null::timestamp as next_seen_at,
                station_id as from_station_id, null::varchar as to_station_id, null::bigint as window_minutes
                from hourly_pair where station_id is not null
            union all select 'seen-again', bike_id, collected_at, t, station_id, s, date_diff('minute', collected_at, t)
                from hourly_pair where not final and station_id is not null and station_id is distinct from s
                and date_diff('minute', collected_at, t) <= {STREAM_WINDOW}""",
        "stream_gaps": f"""select * from (select lag(collected_at) over (order by collected_at) as previous_collected_at,
            collected_at, date_diff('second', lag(collected_at) over (order by collected_at), collected_at)
            as gap_seconds from runs) where gap_seconds > {STREAM_GAP_SECONDS}""",
        "stream_labels": f"""select b.station_id, b.collected_at, f.collected_at as target_collected_at,
            f.bikes_now as bikes_future, f.bikes_now = 0 as empty_future
            from (select *, collected_at + interval '{HORIZON} minutes' as t from base) b
            asof join base f on f.station_id = b.station_id and b.t <= f.collected_at
            where f.collected_at <= b.collected_at + interval '{MAX_DELAY} minutes'""",
    }


def oracle_sql() -> dict[str, str]:
    return {name: sql(text) for name, text in {**statements(), **file_statements(), **model_statements(), **stream_statements()}.items()}
