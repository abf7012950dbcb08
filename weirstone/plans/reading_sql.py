"""SQL (DuckDB) of the normalisation of samples, for the oracles."""

#: CTEs `st` (one row per station) and `r` (sample_id, station_id, pipeline, interval_s, us, value, window_id); us is null where unreadable.
READINGS = r"""
k as (select s.*, case when regexp_matches(station_id, '^[A-Z]+[1-9][0-9]*$') then station_id else
        regexp_replace(regexp_replace(upper(translate(station_id, 'ＳｓＡａＢｂ０１２３４５６７８９', 'SsAaBb0123456789')), '[^A-Z0-9]', '', 'g'), '^([A-Z]*)0+([0-9])', '\1\2') end as skey, upper(trim(timestamp)) as t from samples s),
st as (select station_id, arg_max(pipeline, seq) as pipeline, arg_max(interval_s, seq) as interval_s, arg_max(utc_offset, seq) as utc_offset from stations group by station_id),
z as (select k.sample_id, st.station_id, st.pipeline, st.interval_s, k.window_id, k.t, case when isnan(k.value) then null else k.value end as value,
        regexp_extract(k.t, '^(\d{4})-?(\d\d)-?(\d\d)[T ](\d\d):?(\d\d):?(\d\d)([.]\d+)? ?(Z|[+-]\d\d(?::?\d\d)?)?$', ['y', 'mo', 'd', 'h', 'mi', 's', 'f', 'z']) as p, st.utc_offset from k join st on st.station_id = k.skey),
o as (select *, try_cast(p.y || '-' || p.mo || '-' || p.d || ' ' || p.h || ':' || p.mi || ':' || p.s || coalesce(p.f, '') as timestamp) as wall, case when p.z = '' then utc_offset when p.z = 'Z' then '+00:00' else p.z end as off from z),
r as (select sample_id, station_id, pipeline, interval_s, window_id, value, cast(case when regexp_matches(t, '^\d{1,11}$') then cast(t as bigint) * 1000000 when regexp_matches(t, '^\d{12,14}$') then cast(t as bigint) * 1000
        else epoch_us(wall) - (case when off[1] = '-' then -1 else 1 end) * (cast(substr(off, 2, 2) as bigint) * 3600 + coalesce(try_cast(regexp_replace(substr(off, 4), ':', '') as bigint), 0) * 60) * 1000000 end as bigint) as us from o)
"""

#: sample_id of the repeats among `r`.
REPEATS = """
(select distinct a.sample_id from (select *, us // 3000000 as b from r where us is not null) a
 join (select sample_id as i, station_id as s, us as u, unnest([us // 3000000 - 1, us // 3000000, us // 3000000 + 1]) as b from r where us is not null) c
 on c.s = a.station_id and c.b = a.b and c.i < a.sample_id and abs(c.u - a.us) <= 3000000)
"""
