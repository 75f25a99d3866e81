"""Common parts of the SQL equivalents (DuckDB dialect)."""

from __future__ import annotations

EV = """ev as (
  select event_id, user_id as station, epoch_us(ts) as at_us, event_type as class,
         value / 500.0::double as height,
         cast(regexp_extract(props, '(\\d+)', 1) as integer) as k,
         cast(regexp_extract(props, '(\\d+)', 1) as integer) % 3 + 1 as n_annotators
  from events)"""

STATIONS = """stations as (
  select user_id as station, min(epoch_us(ts)) as start_us, max(epoch_us(ts)) as end_us
  from events group by 1)"""

FILES = """starts as (
  select *, lead(at_us) over w as next_us, row_number() over w - 1 as ordinal
  from (select station, at_us, case when max(k) >= 90 then 120 else 60 end as fs
        from ev where class = 'view' group by station, at_us)
  window w as (partition by station order by at_us)),
files as (
  select station, ordinal, at_us as start_us, next_us, fs, n_samples,
         at_us + n_samples * 3600000000 // fs as end_us
  from (select *, (next_us - at_us) * fs // 3600000000 as n_samples from starts where next_us is not null)
  where n_samples > 0)"""

SUMMARY = """summary as (
  select station, min(start_us) as dataset_start_us, arg_max(end_us, start_us) as dataset_end_us,
         arg_min(fs, start_us) as sampling_f,
         greatest(arg_min(end_us - start_us, start_us), arg_max(end_us - start_us, start_us)) as files_duration_us,
         max(end_us - start_us) as longest_us, count(*) as n_files
  from files group by station)"""

# tiles of 6 hours over each station's period
TILES = """tiles as (
  select station, k, start_us + k * 21600000000 as seg_start_us,
         start_us + (k + 1) * 21600000000 as seg_end_us,
         start_us + k * 21600000000 + 10800000000 as center_us
  from (select station, start_us, unnest(range((end_us - start_us) // 21600000000)) as k from stations))"""

# annotations placed in tiles, offsets in tenths of a second (half to even)
PLACED = """placed0 as (
  select e.*, greatest(ceil((e.at_us - s.start_us) / 2.16e10)::bigint - 1, 0) as tile,
         s.start_us, (s.end_us - s.start_us) // 21600000000 as n_tiles
  from ev e join stations s using (station) where e.class in ('error', 'click', 'purchase')),
placed1 as (
  select *, at_us - (start_us + tile * 21600000000 + 10800000000) as offset_us
  from placed0 where tile < n_tiles),
placed as (
  select *, case when r > 50000 or (r = 50000 and q % 2 <> 0) then q + 1 else q end as tenths
  from (select *, offset_us - q * 100000 as r
        from (select *, floor(offset_us / 1e5)::bigint as q from placed1)))"""

PICKS = """picks as (
  select station, tile as k, tenths / 10.0::double as offset_s, n_annotators, count(*) as copies
  from placed group by all)"""


def stamp(us: str) -> str:
    return f"strftime(make_timestamp({us}), '%Y%m%d_%H%M%S')"


# detections (errors) against truths (purchases) of a user's day, tolerance 3 hours
MATCHED = """d as (select *, at_us // 86400000000 as day from ev where class = 'error'),
t as (select distinct station, at_us, at_us // 86400000000 as day from ev where class = 'purchase'),
near as (
  select d.station, d.day, d.event_id, d.at_us as pos, d.height, t.at_us as truth,
         row_number() over (partition by d.event_id order by abs(d.at_us - t.at_us), t.at_us) as r
  from d join t using (station, day)),
hits as (select * from near where r = 1 and abs(pos - truth) < 10800000000),
best as (
  select *, row_number() over (partition by station, day, truth order by height desc, pos) as rn,
         count(*) over (partition by station, day, truth) as n_hits
  from hits),
tp as (select * from best where rn = 1)"""

OUTCOMES = """segs as (select distinct station, at_us // 86400000000 as day from ev),
outcomes as (
  select s.station, s.day, (t.day is not null)::int as truth, d.score
  from segs s
  left join (select distinct station, at_us // 86400000000 as day from ev where class = 'purchase') t using (station, day)
  left join (select station, at_us // 86400000000 as day, max(height) as score from ev where class = 'error' group by all) d using (station, day))"""

WAVE = """wave as (
  select vec_id as id, unnest(range(len(embedding))) as i, unnest(embedding)::double as v
  from embeddings)"""

# 16-point frames, hop 8, of 64-point signals sampled at 8 Hz
SPECTRUM = """framed as (
  select w.id, f.t as t_bin, w.i - 8 * f.t as j, w.v
  from wave w join (select unnest(range(7)) as t) f on w.i >= 8 * f.t and w.i < 8 * f.t + 16),
centered as (
  select id, t_bin, j, (v - avg(v) over (partition by id, t_bin)) * (0.54 - 0.46 * cos(2 * pi() * j / 16)) as x
  from framed),
norm as (select sum(pow(0.54 - 0.46 * cos(2 * pi() * n / 16), 2)) as w2 from range(16) r(n)),
dft as (
  select id, t_bin, b as f_bin, sum(x * cos(2 * pi() * b * j / 16)) as re, sum(x * sin(2 * pi() * b * j / 16)) as im
  from centered, (select unnest(range(9)) as b) group by id, t_bin, b),
spectrum as (
  select id, t_bin, f_bin,
         (case when f_bin in (0, 8) then 1 else 2 end) * (pow(re, 2) + pow(im, 2)) / (8 * w2) as power
  from dft, norm),
db as (select id, t_bin, f_bin, 10 * log10(power + 1e-20) as v from spectrum)"""

FRAMES = WAVE + ",\n" + SPECTRUM

_LOW = (
    "[0, .03314563036811942, -.06629126073623884, -.17677669529663689, .4198446513295126,"
    " .9943689110435825, .4198446513295126, -.17677669529663689, -.06629126073623884, .03314563036811942]::double[]"
)
_HIGH = "[0, 0, 0, .3535533905932738, -.7071067811865476, .3535533905932738, 0, 0, 0, 0]::double[]"


def wavelet_level(source: str, out: str) -> str:
    """One wavelet level of ``source(id, i, v)`` as ``out(id, i, v)`` and ``out_d(id, i, v)``."""
    return f"""{out}_n as (select id, count(*) as n from {source} group by id),
{out}_k as (select id, n, unnest(range((n + 9) // 2)) as k from {out}_n),
{out}_idx as (
  select id, n, k, j, 2 * k + 1 - j as q from {out}_k, (select unnest(range(10)) as j)),
{out}_c as (
  select x.id, x.k, sum(({_LOW})[x.j + 1] * s.v) as a, sum(({_HIGH})[x.j + 1] * s.v) as d
  from {out}_idx x join {source} s
    on s.id = x.id and s.i = case when q < 0 then -q - 1 when q >= n then 2 * n - 1 - q else q end
  group by all),
{out} as (select id, k as i, a as v from {out}_c),
{out}_d as (select id, k as i, d as v from {out}_c)"""


def with_(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"
