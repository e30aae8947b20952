"""The same queries as DuckDB SQL."""

from __future__ import annotations

STREAM = """ev as (select user_id as night, ts, event_id, value, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) as epoch,
  case event_type when 'click' then 0 when 'error' then 1 when 'purchase' then 2 when 'signup' then 3 when 'view' then 4 end as stage from events)"""
METRICS = """m as (select night, count(*) as n_epochs, count(*) * 30 / 3600.0::double as duration_h, (count(*) - count_if(stage = 0)) * 100.0::double / count(*) as efficiency_pct,
  count_if(stage = 0) * 100.0::double / count(*) as wake_pct, count_if(stage = 1) * 100.0::double / count(*) as n1_pct, count_if(stage = 2) * 100.0::double / count(*) as n2_pct,
  count_if(stage = 3) * 100.0::double / count(*) as n3_pct, count_if(stage = 4) * 100.0::double / count(*) as rem_pct, count_if(stage in (3, 4)) * 100.0::double / count(*) as n3_rem_pct from ev group by night)"""
RUNS = """rn as (select night, stage, min(epoch) as first, max(epoch) as last, count(*) as length from
  (select *, row_number() over (partition by night order by epoch) - row_number() over (partition by night, stage order by epoch) as island from ev) group by night, stage, island)"""
SEG = """sg as (select vec_id as epoch, embedding as s, len(embedding) as n from embeddings),
  x as (select epoch, n, unnest(range(0, n)) as i, cast(unnest(s) as double) as v from sg)"""
POWER = SEG + """, b as (select epoch, n, i, v, unnest(range(1, 33)) as k from x),
  pw as (select epoch, k, power(sum(v * cos(2 * pi() * k * i / n)), 2) + power(sum(v * sin(2 * pi() * k * i / n)), 2) as power from b group by epoch, k)"""
DAYS = """dd as (select cast(o_orderdate as date) as day, count(*) as n, sum(o_totalprice) as total, avg(o_totalprice) as mean from orders group by 1),
  ser as (select *, row_number() over (order by day) - 1 as idx from dd)"""
FEAT = """ft as (select l_orderkey as night, l_linenumber as epoch, l_returnflag as grp, case when l_orderkey % 7 <> 0 then l_quantity end as quantity, l_extendedprice as price,
  case when l_partkey % 3 <> 0 then l_discount end as discount, l_tax as tax from lineitem)"""
CHAN = """cs as (select strftime(ts, '%Y-%m') as night, cast(floor(epoch_us(ts) / 21600000000) as bigint) as sample, event_type as channel, avg(value) as value from events group by 1, 2, 3)"""
EDGES = CHAN + """, ed as (select a.night, a.channel as ch_i, b.channel as ch_j, corr(a.value, b.value) as value, count(*) as n
  from cs a join cs b on a.night = b.night and a.sample = b.sample and a.channel < b.channel group by 1, 2, 3)"""
ELEC = """el as (select c_name as name, (c_custkey * 37 % 201) / 100.5::double - 1 as x, (c_custkey * 53 % 301) / 150.5::double - 1 as y, (c_custkey * 71 % 401) / 200.5::double - 1 as z from customer)"""
WINS = STREAM + """, ew as (select night, epoch as win, case stage when 0 then 'SS' when 1 then 'KC' when 2 then 'SW' when 3 then 'SAW' else 'VSW' end as label,
  cast(floor(value * 1000) as bigint) % 100 / 100.0::double as proba from ev),
  iv as (select night, label, min(win) * 300 as start, (max(win) + 1) * 300 as "end", avg(proba) as p from
    (select *, win - row_number() over (partition by night, label order by win) as island from ew where proba > 0.2) group by night, label, island)"""


def r6(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) + 0.0 as {c.split('.')[-1]}" for c in columns)


def acf_of(column: str, last: int) -> str:
    return f"""(select l.lag, sum((a.{column} - s.m) * (b.{column} - s.m)) / max(s.n * s.v) as acf, max(s.n) as n from (select unnest(range(0, {last + 1})) as lag) l, ser a, ser b,
  (select avg({column}) as m, var_pop({column}) as v, count(*) as n from ser) s where b.idx = a.idx + l.lag group by l.lag)"""


def report_row(column: str) -> str:
    at = ", ".join(f"round(max(case when lag = {k} then acf end), 6) + 0.0 as acf{k}" for k in (1, 3, 7, 14))
    sig = ", ".join(f"max(case when lag = {k} then abs(acf) > 1.959963984540054 / sqrt(n) end) as sig{k}" for k in (1, 3, 7, 14))
    return f"select '{column}' as metric, (select round(avg({column}), 6) + 0.0 from ser) as mean, (select round(stddev_samp({column}), 6) + 0.0 from ser) as sd, {at}, {sig} from {acf_of(column, 14)}"


FEATURES = ["quantity", "price", "discount", "tax"]
LONG = " union all ".join(f"select '{c}' as feature, cast({c} as double) as value from ft" for c in FEATURES)

ORACLE = {
    "nightly_sleep_metrics": f"with {STREAM}, {METRICS} select night, n_epochs, {r6('duration_h', 'efficiency_pct', 'wake_pct', 'n1_pct', 'n2_pct', 'n3_pct', 'rem_pct', 'n3_rem_pct')} from m",
    "stage_label_join": f"with {STREAM} select night, epoch, case stage when 0 then 'Wake' when 1 then 'N1' when 2 then 'N2' when 3 then 'N3' when 4 then 'REM' end as label from ev",
    "stage_distribution_pct": f"with {STREAM}, c as (select night, stage, count(*) as n from ev group by all), p as (select *, n * 100.0::double / sum(n) over (partition by night) as pct from c) select night, stage, n, {r6('pct')}, printf('%.1f%%', round_even(pct, 1)) as pct_text from p",
    "stage_matrix": f"with {STREAM}, {METRICS} select night, round(wake_pct, 6) + 0.0 as wake, round(n1_pct, 6) + 0.0 as n1, round(n2_pct, 6) + 0.0 as n2, round(n3_pct, 6) + 0.0 as n3, round(rem_pct, 6) + 0.0 as rem from m",
    "stage_transition_matrix": f"with {STREAM}, t as (select stage, lead(stage) over (partition by night order by epoch) as next_stage from ev) select stage, next_stage, count(*) as n from t where next_stage is not null group by all",
    "stage_runs": f"with {STREAM}, {RUNS} select night, stage, first, last, length from rn",
    "stage_run_metrics": f"with {STREAM}, {RUNS}, t as (select night, stage, sum(length)::double as total, count(*)::double as runs, avg(length) as ml from rn group by all), u as (select *, sum(total) over (partition by night) as whole from t) select night, stage, round(total / whole, 6) + 0.0 as coverage, round(ml * 30, 6) + 0.0 as mean_duration_s, round(runs * 60 / (whole * 30), 6) + 0.0 as onsets_per_min from u",
    "trim_leading_wake": f"with {STREAM}, f as (select *, coalesce(min(case when stage <> 0 then epoch end) over (partition by night), 0) as f from ev) select night, epoch, stage from f where epoch >= f",
    "sleep_dashboard": f"with {STREAM}, {METRICS}, l as (" + " union all ".join(f"select '{c}' as metric, {c} as v from m" for c in ("wake_pct", "n3_pct", "rem_pct", "duration_h", "efficiency_pct")) + ") select metric, round(avg(v), 6) + 0.0 as mean, round(stddev_pop(v), 6) + 0.0 as sd, count(v) as nights from l group by metric",
    "epoch_tumbling_stats": f"with {STREAM} select night, cast(epoch // 10 as integer) as epoch, round(avg(value), 6) + 0.0 as mean, round(var_pop(value), 6) + 0.0 as var, round(sqrt(avg(value * value)), 6) + 0.0 as rms, count(*) as n from ev group by night, epoch // 10 having count(*) = 10",
    "epoch_sliding_mean": f"with {SEG}, w as (select epoch, n, unnest(range(0, (n - 16) // 8 + 1)) as win from sg) select w.epoch, cast(w.win as integer) as win, round(avg(x.v), 6) + 0.0 as mean from w join x on x.epoch = w.epoch and x.i >= w.win * 8 and x.i < w.win * 8 + 16 group by 1, 2",
    "epoch_range_window": f"with {STREAM} select night, epoch, count(*) over w as n, round(avg(value) over w, 6) + 0.0 as mean from ev window w as (partition by night order by ts range between interval 1 hour preceding and current row)",
    "centred_rolling_mean": f"with {STREAM} select night, epoch, round(case when count(value) over w = 20 then avg(value) over w end, 6) + 0.0 as m from ev window w as (partition by night order by epoch rows between 10 preceding and 9 following)",
    "epoch_gap_fill": f"with {STREAM}, e as (select night, cast(floor(epoch_us(ts) / 43200000000) as bigint) as epoch, avg(value) as value, max(stage) as stage from ev group by 1, 2), d as (select night, unnest(range(min(epoch), max(epoch) + 1)) as epoch from e group by night) select d.night, d.epoch, coalesce(e.stage, 0) as stage, {r6('e.value')}, e.epoch is null as is_gap from d left join e on d.night = e.night and d.epoch = e.epoch",
    "segment_gap_detect": f"with {STREAM}, g as (select night, epoch, round(epoch_us(ts) / 1000000.0::double - (lag(epoch_us(ts) / 1000000.0::double) over w + lag(value) over w), 3) as gap_seconds from ev window w as (partition by night order by ts)) select night, epoch, gap_seconds, cast(ceil(greatest(gap_seconds, 0) / 30) as bigint) as gap_epochs from g",
    "stage_epoch_align": "select d.doc_id, coalesce(l.quality, -1) as stage from documents d left join labels l using (doc_id)",
    "window_to_epoch_counts": f"with {STREAM}, n as (select night, count(*) as n from ev group by night), b as (select night, unnest(range(0, 7)) as e, n / 7.0::double as r from n), s as (select night, e, round_even(e * r, 0) as a, round_even((e + 1) * r, 0) as b from b) select s.night, cast(e as integer) as epoch, " + ", ".join(f"cast(count_if(stage = {k}) as bigint) as c{k}" for k in range(5)) + " from s join ev on ev.night = s.night and ev.epoch >= a and ev.epoch < b group by 1, 2",
    "segment_renumber": "with u as (select user_id, ts, event_id, case when event_id % 2 = 0 then 'a' else 'gap' end as segment from events) select user_id, segment, event_id, row_number() over (partition by user_id order by segment, ts, event_id) - 1 as epoch from u",
    "time_slices": f"with {STREAM} select night, cast(epoch_us(ts) // 600000000 * 600 as bigint) as start, count(*) as n, round(sum(value), 6) + 0.0 as total from ev group by 1, 2",
    "date_parts": "select event_id, strftime(ts, '%Y-%m-%d') as date, strftime(ts, '%H:%M:%S') as time, cast(year(ts) as integer) as year, cast(month(ts) as integer) as month, cast(day(ts) as integer) as day, cast(hour(ts) as integer) as hour, cast(minute(ts) as integer) as minute from events",
    "recording_catalog": "with p as (select page_id, regexp_extract(url, '^(https?)://([^/?#]*)/([a-z]+)/([0-9]+)', 2) as host, regexp_extract(url, '^(https?)://([^/?#]*)/([a-z]+)/([0-9]+)', 3) as lang, regexp_extract(url, '^(https?)://([^/?#]*)/([a-z]+)/([0-9]+)', 4) as num from pages where regexp_matches(url, '^(https?)://([^/?#]*)/([a-z]+)/([0-9]+)')) select min(page_id) as page_id, host, lang, cast(num as bigint) as num from p group by host, lang, num",
    "file_precedence_antijoin": "select doc_id, 'pkl' as kind from labels union all select doc_id, 'csv' from documents where doc_id not in (select doc_id from labels)",
    "resume_not_done": "select doc_id, source from documents where doc_id not in (select doc_id from labels where quality = 1)",
    "latest_per_key": "select user_id, event_type, event_id, round(value, 6) + 0.0 as value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as rn from events) where rn = 1",
    "seg_moments": f"with {SEG}, m as (select epoch, avg(v) as m, sqrt(avg(v * v)) as rms from x group by epoch), c as (select x.epoch, max(m.m) as m, max(rms) as rms, avg(power(v - m.m, 2)) as m2, avg(power(v - m.m, 3)) as m3, avg(power(v - m.m, 4)) as m4 from x join m using (epoch) group by x.epoch) select epoch, round(m, 6) + 0.0 as mean, round(m2, 6) + 0.0 as variance, round(m3 / power(m2, 1.5), 6) + 0.0 as skewness, round(m4 / (m2 * m2) - 3, 6) + 0.0 as kurtosis, {r6('rms')} from c",
    "seg_line_length_zcr": f"with {SEG}, d as (select epoch, n, abs(v - lag(v) over w) as d, abs(cast(v < 0 as integer) - lag(cast(v < 0 as integer)) over w) as z from x window w as (partition by epoch order by i)) select epoch, round(sum(d), 6) + 0.0 as line_length, round(sum(z)::double / max(n), 6) + 0.0 as zcr from d group by epoch",
    "hjorth": f"with {SEG}, d as (select epoch, i, v, coalesce(v - lag(v) over (partition by epoch order by i), 0) as d from x), e as (select *, coalesce(d - lag(d) over (partition by epoch order by i), 0) as dd from d), q as (select epoch, var_samp(v) as a, var_samp(d) as b, var_samp(dd) as c from e group by epoch) select epoch, round(sqrt(b / a), 6) + 0.0 as mobility, round(sqrt(c / b) / sqrt(b / a), 6) + 0.0 as complexity from q",
    "acf_lag_features": f"with {SEG}, m as (select *, v - avg(v) over (partition by epoch) as c from x), l as (select *, lead(c, 1) over w as c1, lead(c, 10) over w as c10 from m window w as (partition by epoch order by i)) select epoch, round(sum(c * c1) / sum(c * c), 6) + 0.0 as acf_lag1, round(sum(c * c10) / sum(c * c), 6) + 0.0 as acf_lag10 from l group by epoch",
    "dft_band_power": f"with {POWER}, s as (select epoch, " + ", ".join(f"coalesce(sum(power) filter (k between {a} and {b}), 0) as {n}" for n, a, b in (("delta", 0.5, 4), ("theta", 4, 8), ("alpha", 8, 13), ("beta", 13, 30), ("gamma", 30, 45))) + " from pw group by epoch) select epoch, " + ", ".join(f"round({c} / (delta + theta + alpha + beta + gamma), 6) + 0.0 as {c}" for c in ("delta", "theta", "alpha", "beta", "gamma")) + " from s",
    "spectral_entropy": f"with {POWER}, q as (select epoch, power / sum(power) over (partition by epoch) as p from pw) select epoch, round(-sum(p * log2(p)), 6) + 0.0 as entropy from q where p > 0 group by epoch",
    "spectral_moments_sef": f"with {POWER}, q as (select epoch, k::double as f, power / sum(power) over (partition by epoch) as p, sum(power) over (partition by epoch order by k) / sum(power) over (partition by epoch) as r from pw) select epoch, round(sum(p * f), 6) + 0.0 as centroid, round(sqrt(greatest(sum(p * f * f) - sum(p * f) * sum(p * f), 0)), 6) + 0.0 as spread, min(case when r >= 0.5 then f end) as sef50, min(case when r >= 0.9 then f end) as sef90, min(case when r >= 0.95 then f end) as sef95 from q group by epoch",
    "loglog_slope": f"with {POWER} select epoch, round(regr_slope(log10(power), log10(k)), 6) + 0.0 as slope, round(regr_intercept(log10(power), log10(k)), 6) + 0.0 as intercept, round(-regr_slope(log10(power), log10(k)), 6) + 0.0 as beta, count(*) as bins from pw group by epoch",
    "permutation_entropy": f"with {STREAM}, t as (select night, value as a, lead(value) over w as b, lead(value, 2) over w as c from ev window w as (partition by night order by epoch)), n as (select night, cast(a <= b as integer) * 4 + cast(b <= c as integer) * 2 + cast(a <= c as integer) as pat, count(*) as n from t where c is not null group by all), p as (select night, n::double / sum(n) over (partition by night) as p from n) select night, round(-sum(p * log2(p)), 6) + 0.0 as entropy from p group by night",
    "channel_corr_pairs": f"with {EDGES} select night, ch_i, ch_j, {r6('value')}, n from ed",
    "graph_degree_clustering": f"with {EDGES}, e9 as (select night, ch_i, ch_j, round(value, 9) as value from ed), th as (select night, quantile_cont(abs(value), 0.4) as t from e9 group by night), s as (select e9.* from e9 join th using (night) where abs(value) > t), bo as (select night, ch_i as a, ch_j as b from s union all select night, ch_j, ch_i from s), no as (select night, ch_i as a from e9 union select night, ch_j from e9), de as (select no.night, no.a, count(bo.b) as d from no left join bo on no.night = bo.night and no.a = bo.a group by 1, 2), tr as (select x.night, x.a, count(*) as t from bo x join bo y on x.night = y.night and x.a = y.a and x.b < y.b join bo z on z.night = x.night and z.a = x.b and z.b = y.b group by 1, 2) select de.night, count(*) as nodes, round(avg(d), 6) + 0.0 as mean_degree, round(avg(case when d >= 2 then coalesce(t, 0) * 2.0::double / (d * (d - 1)) else 0 end), 6) + 0.0 as clustering from de left join tr using (night, a) group by de.night",
    "gfp_rms": f"with {CHAN}, g as (select night, sample, sqrt(avg(value * value)) as g from cs group by all) select night, round(avg(g), 6) + 0.0 as gfp_rms from g group by night",
    "roi_mean": f"with {CHAN} select night, sample, case when channel in ('click', 'view') then 'front' else 'back' end as region, round(avg(value), 6) + 0.0 as mean, count(value) as n from cs where channel in ('click', 'view', 'purchase', 'signup') group by 1, 2, 3",
    "rank_bin_channel_pick": f"with {ELEC}, s as (select *, case when x < 0 then 'left' else 'right' end as side from el), r as (select *, cast(((row_number() over (partition by side order by y desc, name) - 1) * 5) // count(*) over (partition by side) as integer) as bin from s), m as (select side, bin, median(y) as my, median(z) as mz from r group by all), d as (select r.side, r.bin, name, row_number() over (partition by r.side, r.bin order by round(power(y - my, 2) + power(z - mz, 2), 9), name) as k from r join m on r.side = m.side and r.bin = m.bin) select side, bin, name from d where k = 1",
    "region_case": f"with {ELEC}, u as (select round(x / coalesce(nullif(sqrt(x * x + y * y + z * z), 0), 1), 9) as x, round(y / coalesce(nullif(sqrt(x * x + y * y + z * z), 0), 1), 9) as y from el) select case when y > 0.3 then 'F' when y < -0.5 then 'O' when abs(x) > 0.5 then 'T' when y <= -0.1 then 'P' else 'C' end as region, count(*) as n from u group by 1",
    "event_intervals": f'with {WINS} select night, label, start, "end", "end" - start as duration, round(p, 6) + 0.0 as predict_proba from iv',
    "event_describe": f"with {WINS}, k as (select label, round(p, 9) as p from iv where round(p, 9) >= case label when 'SS' then 0.6 when 'KC' then 0.3 else 0.5 end) select label, count(*) as n, round(avg(p) * 100, 6) + 0.0 as mean_proba, round(count(*) * 100.0::double / sum(count(*)) over (), 6) + 0.0 as percentage from k group by label",
    "annotation_json": f"with {WINS} select night, label, start, substr(md5(concat_ws('|', night, label, start, \"end\")), 1, 10) as id, label as body_label, \"end\" as body_end from iv",
    "nightly_acf": f"with {DAYS} select cast(lag as integer) as lag, {r6('acf')}, round(1.959963984540054 / sqrt(n), 6) + 0.0 as bound, lag > 0 and abs(acf) > 1.959963984540054 / sqrt(n) as significant from {acf_of('n', 30)}",
    "nightly_ccf": f"with {DAYS} select cast(l.lag as integer) as lag, round(corr(a.n, b.mean), 6) + 0.0 as r, count(*) as n from (select unnest(range(-10, 11)) as lag) l, ser a, ser b where b.idx = a.idx + l.lag group by l.lag",
    "weekly_rhythm_lag7": f"with {DAYS} select round(acf, 6) + 0.0 as r7 from {acf_of('n', 7)} where lag = 7",
    "rolling_autocorr": f"with {DAYS}, p as (select idx, total as x, lead(total) over (order by idx) as y from ser), q as (select idx, count(y) over w as c, corr(x, y) over w as r from p window w as (order by idx rows between current row and 18 following)) select cast(idx + 10 as bigint) as idx, 1 as lag, {r6('r')} from q where c = 19",
    "autocorr_report": f"with {DAYS} {report_row('n')} union all {report_row('mean')}",
    "nan_profile": f"with {FEAT}, l as ({LONG}), g as (select feature, count(*) as n, count(*) - count(value) as n_missing from l group by feature), h as (select *, n_missing::double / n as r from g) select feature, n, n_missing, round(r, 6) + 0.0 as ratio, case when r = 0 then '0' when r <= 0.1 then '0-10' when r <= 0.3 then '10-30' when r <= 0.5 then '30-50' when r < 1 then '>50' else '100' end as bucket from h",
    "qc_iqr_outliers": f"with {FEAT}, l as ({LONG}), q as (select feature, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from l where value is not null group by feature) select feature, {r6('q1', 'q3')}, (select count(*) from l where l.feature = q.feature and (value < q1 - 0.5 * (q3 - q1) or value > q3 + 0.5 * (q3 - q1))) as n_out from q",
    "qc_median_impute": f"with {FEAT}, k as (select *, cast(quantity is null as integer) + cast(discount is null as integer) as gone from ft), r as (select * from k where gone <= 1.2), md as (select median(quantity) as mq, median(discount) as mdi from r), i as (select grp, coalesce(quantity, mq) as quantity, price, coalesce(discount, mdi) as discount, tax from r, md), q as (select " + ", ".join(f"quantile_cont({c}, 0.25) as {c}1, quantile_cont({c}, 0.75) as {c}3" for c in FEATURES) + " from i), o as (select i.*, " + " + ".join(f"cast({c} < {c}1 - 3 * ({c}3 - {c}1) or {c} > {c}3 + 3 * ({c}3 - {c}1) as integer)" for c in FEATURES) + " as bad from i, q) select grp, count(*) as n, " + ", ".join(f"round(avg({c}), 6) + 0.0 as {c}" for c in FEATURES) + " from o where bad <= 1 group by grp",
    "robust_scale": f"with {FEAT}, q as (select " + ", ".join(f"median({c}) as {c}2, (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) / 1.3489795003921634::double as {c}s" for c in ("price", "tax")) + " from ft) select night, epoch, " + ", ".join(f"round(({c} - {c}2) / coalesce(nullif({c}s, 0), 1), 6) + 0.0 as {c}" for c in ("price", "tax")) + " from ft, q",
    "feature_corr_pairs": f"with {FEAT} " + " union all ".join(f"select '{a}' as feature_i, '{b}' as feature_j, round(corr({a}, {b}), 6) + 0.0 as r from ft" for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]),
    "cluster_profile": f"with {FEAT}, l as (select grp as cluster, 'price' as feature, price as value from ft union all select grp, 'tax', tax from ft), w as (select feature, avg(value) as m, stddev_pop(value) as s from l group by feature), c as (select cluster, feature, avg(value) as c from l group by all), z as (select cluster, feature, (c - m) / coalesce(nullif(s, 0), 1e-8) as z from c join w using (feature)) select cluster, feature, {r6('z')}, cast(row_number() over (partition by cluster order by round(abs(z), 9) desc, feature) as integer) as rank from z",
    "cluster_indices": f"with {FEAT}, c as (select grp, count(*) as n, avg(price) as p, avg(tax) as t from ft group by grp), i as (select ft.grp, max(c.n) as n, max(p) as p, max(t) as t, avg(sqrt(power(price - p, 2) + power(tax - t, 2))) as s, sum(power(price - p, 2) + power(tax - t, 2)) as w from ft join c using (grp) group by ft.grp), d as (select a.grp, max((a.s + b.s) / sqrt(power(a.p - b.p, 2) + power(a.t - b.t, 2))) as r from i a join i b on a.grp <> b.grp group by a.grp), g as (select avg(price) as gp, avg(tax) as gt from ft) select (select round(avg(r), 6) + 0.0 from d) as davies_bouldin, round((sum(n * (power(p - gp, 2) + power(t - gt, 2))) / (count(*) - 1)) / (sum(w) / (sum(n)::double - count(*))), 6) + 0.0 as calinski_harabasz from i, g",
    "cluster_by_group": f"with {FEAT}, n as (select epoch % 3 as cluster, grp, count(*) as n from ft group by all) select cluster, grp, round(n * 100.0::double / sum(n) over (partition by cluster), 6) + 0.0 as pct from n",
    "feature_histogram": f"with {FEAT} select cast(floor(price / 2400.0::double) + 1 as bigint) as bucket, count(*) as n from ft group by 1",
    "cube_rollup": f"with {STREAM} select night, stage, count(*) as n, round(sum(value), 2) as total from ev group by cube (night, stage)",
    "joins_semi_anti": "select o_orderstatus, count(*) as n, case when o_custkey in (select c_custkey from customer where c_acctbal > 5000) then 'semi' else 'anti' end as kind from orders group by all",
    "set_ops": "select count(*) as n, cast(sum(user_id) as bigint) as total, 'union' as op from (select user_id from events union select o_custkey from orders) union all select count(*), cast(sum(user_id) as bigint), 'intersect' from (select user_id from events intersect select o_custkey from orders) union all select count(*), cast(sum(user_id) as bigint), 'except' from (select user_id from events except select o_custkey from orders)",
    "topk_per_group": "select o_orderstatus, cast(rank as integer) as rank, o_orderkey from (select *, row_number() over (partition by o_orderstatus order by o_totalprice desc, o_orderkey) as rank from orders) where rank <= 10",
    "sample_entropy_pairs": f"with {SEG}, y as (select * from x), r as (select epoch, 0.2 * stddev_pop(v) as r from y group by epoch), t as (select epoch, i, v as a, lead(v) over w as b, lead(v, 2) over w as c from y window w as (partition by epoch order by i)) select t.epoch, count(*) as pairs from t join t u on t.epoch = u.epoch and t.i < u.i join r on r.epoch = t.epoch where u.c is not null and t.c is not null and greatest(abs(t.a - u.a), abs(t.b - u.b), abs(t.c - u.c)) < r group by t.epoch",
    "sample_entropy_pairs_whole": f"with {SEG}, y as (select * from x), r as (select epoch, 0.2 * stddev_pop(v) as r from y group by epoch), t as (select epoch, i, v as a, lead(v) over w as b, lead(v, 2) over w as c from y window w as (partition by epoch order by i)) select t.epoch, count(*) as pairs from t join t u on t.epoch = u.epoch and t.i < u.i join r on r.epoch = t.epoch where u.c is not null and t.c is not null and greatest(abs(t.a - u.a), abs(t.b - u.b), abs(t.c - u.c)) < r group by t.epoch",
    "stream_window_avg": "select event_type, cast(epoch_us(ts) // 21600000000 * 21600 as bigint) as start, count(*) as n, round(sum(value), 2) as total from events group by 1, 2",
    "stream_sliding_count": "with s as (select event_type, cast(epoch_us(ts) // 3600000000 * 3600 as bigint) as a from events), u as (select event_type, a as start from s union all select event_type, a - 3600 from s) select event_type, start, count(*) as n from u group by 1, 2",
    "stream_session": "with g as (select user_id, ts, case when ts - lag(ts) over w >= interval 2 hour or lag(ts) over w is null then 1 else 0 end as new from events window w as (partition by user_id order by ts)), h as (select *, sum(new) over (partition by user_id order by ts) as k from g) select user_id, cast(epoch_us(min(ts)) // 1000000 as bigint) as start, count(*) as n from h group by user_id, k",
    "stream_dedupe": "select event_id, user_id from events",
    "stream_gap_detect": "with g as (select user_id, epoch_us(ts) as us, lag(epoch_us(ts)) over (partition by user_id order by ts) as prev from events) select user_id, us as start, round((us - prev) / 1000000.0::double, 3) as gap_s from g where us - prev > 21600000000",
    "feature_tags": "with n as (select distinct case event_id % 5 when 0 then 'psd_' when 1 then 'acf_' when 2 then 'lz_' when 3 then 'rqa_' else 'x_' end || event_type as name from events) select name, case substr(name, 1, 2) when 'ps' then 'spectral' when 'ac' then 'acf' when 'lz' then 'complexity' when 'rq' then 'rqa' else 'other' end as tag from n",
    "stride_subsample": f"with {STREAM}, k as (select *, greatest(1, count(*) over (partition by night) // 20) as k from ev) select night, epoch from k where epoch % k = 0",
}

NIGHTS = "fn as (select cast(l_orderkey % 8 as integer) as night, l_orderkey * 8 + l_linenumber as epoch, cast(l_extendedprice as double) as price, cast(l_tax as double) as tax from lineitem)"
RESULTS = "rs as (select user_id as night, count_if(event_type <> 'error') as n_epochs, count_if(event_type = 'error') as n_gaps, case when user_id % 5 <> 0 then user_id % 7 <> 0 end as ok from events group by user_id)"
CHANNELS = """ce as (select label as night, vec_id, row_number() over (partition by label order by vec_id) - 1 as i, embedding as s from embeddings),
  cg as (select night, cast(i // 5 as integer) as epoch, 'E' || (i % 5 + 1) as channel, s from ce),
  cx as (select night, epoch, channel, unnest(range(0, len(s))) as t, cast(unnest(s) as double) as v from cg)"""
PCA2 = "cr as (select corr(price, tax) as r from ft)"


def describe_row(c: str) -> str:
    return f"select '{c}' as feature, count({c}) as n, " + ", ".join(f"round({e}, 6) + 0.0 as {n}" for e, n in ((f"avg({c})", "mean"), (f"stddev_samp({c})", "sd"), (f"min({c})", "least"), (f"quantile_cont({c}, 0.25)", "q1"), (f"median({c})", "median"), (f"quantile_cont({c}, 0.75)", "q3"), (f"max({c})", "most"))) + " from ft"


def matrix_row(a: str, b: str) -> str:
    lags = "range(1, 11)" if a == b else "range(-10, 11)"
    return f"(select '{a}' as metric_i, '{b}' as metric_j, cast(lag as integer) as lag, round(r, 6) + 0.0 as r from (select l.lag, corr(a.{a}, b.{b}) as r from (select unnest({lags}) as lag) l, ser a, ser b where b.idx = a.idx + l.lag group by l.lag) order by round(abs(r), 9) desc, lag limit 1)"


ORACLE |= {
    "recording_parts": "with p as (select user_id, case when event_id % 2 = 0 then 'a' else '' end as suffix, strftime(ts, '%Y-%m-%d %H:%M:00') as start, strftime(ts, '%Y%m%d_%H%M00') as stamp, event_id from events where event_id % 11 <> 0), k as (select *, row_number() over (partition by user_id, suffix, start order by event_id) as k from p) select cast(user_id as integer) as night, suffix, start, 'Subject-' || user_id || suffix || '_' || stamp || '.mff' as name, event_id as source from k where k = 1",
    "feature_folder_load": f"with {NIGHTS}, k as (select night, price from fn where night % 2 = 0 union all select night, price + 1000 from fn where night % 2 <> 0), t as (select night, tax from fn) select k.night, k.n, k.price, t.tax from (select night, count(*) as n, round(sum(price), 2) as price from k group by night) k join (select night, round(sum(tax), 2) as tax from t group by night) t using (night)",
    "preferred_feature_files": "with p as (select distinct user_id, case when event_type = 'click' then 'binary' else 'csv' end as kind from events) select cast(user_id as integer) as night, '/features/features_night' || user_id || case kind when 'csv' then '.csv' else '.parquet' end as path, kind from p where kind = 'binary' or user_id not in (select user_id from p where kind = 'binary')",
    "pipeline_csv_scan": f"with {NIGHTS} select night, count(*) as n, round(sum(tax), 4) as tax from fn group by night",
    "nightly_results_load": f"with {RESULTS} select night, n_epochs, n_gaps from rs where ok and n_epochs > 0",
    "batch_totals": f"with {RESULTS} select count(*) as nights, count_if(coalesce(ok, false)) as ok, cast(sum(n_epochs) as bigint) as epochs, cast(sum(n_gaps) as bigint) as gaps from rs",
    "nights_in_order": f"with {RESULTS}, st as (select user_id as night, min(ts) as start from events where user_id % 3 <> 0 group by user_id) select rs.night, row_number() over (order by start nulls last, rs.night) as place from rs left join st using (night)",
    "cluster_results_written": f"with {FEAT} select grp as cluster, count(*) as n, round(avg(price), 4) as price, round(avg(tax), 6) + 0.0 as tax from ft group by grp",
    "channel_picks_stored": ORACLE["rank_bin_channel_pick"].replace("* 5)", "* 4)"),
    "feature_table_summary": f"with {FEAT}, l as (" + " union all ".join(f"select '{c}' as feature, epoch, cast({c} as double) as value from ft" for c in FEATURES) + ") select case when feature in ('price', 'tax') then 'money' else 'other' end as tag, count(value) as n, count(distinct feature || '_' || epoch) as names from l group by 1",
    "window_labels_written": f"with {WINS} select night, win, label from ew",
    "upserted_nights": "select user_id as night, count(*) as n, round(sum(value), 2) as total from events group by user_id",
    "array_features_long": f"with {SEG} select epoch, 'short_' || i as name, round(v, 6) + 0.0 as value from x where i < 4 union all select epoch, 'wide', round(avg(v), 6) + 0.0 from x group by epoch having max(n) > 50 union all select epoch, 'wide_' || i, round(v, 6) + 0.0 from x where n <= 50",
    "feature_describe": f"with {FEAT} " + " union all ".join(map(describe_row, FEATURES)),
    "min_max_scale": f"with {FEAT} select night, epoch, round((price - (select min(price) from ft)) / ((select max(price) from ft) - (select min(price) from ft)), 6) + 0.0 as price, 0.5::double as flat from ft",
    "strong_feature_pairs": f"with {FEAT}, c as (" + " union all ".join(f"select '{a}' as feature_i, '{b}' as feature_j, corr({a}, {b}) as r from ft" for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]) + "), k as (select *, cast(row_number() over (order by round(abs(r), 9) desc, feature_i, feature_j) as integer) as rank from c where abs(r) > 0.001) select feature_i, feature_j, round(r, 6) + 0.0 as r, rank from k where rank <= 5",
    "missing_first": f"with {FEAT}, l as ({LONG}), g as (select feature, count(*) - count(value) as n_missing from l group by feature) select feature, n_missing, cast(row_number() over (order by n_missing desc, feature) as integer) as place from g",
    "pca_loadings": f"with {FEAT}, {PCA2}, c as (select unnest([1, 2]) as component) select component, feature, round(case when feature = 'price' or (component = 1) = (r >= 0) then sqrt(0.5) else -sqrt(0.5) end, 6) + 0.0 as loading, round((1 + case component when 1 then abs(r) else -abs(r) end) / 2, 6) + 0.0 as share from cr, c, (select unnest(['price', 'tax']) as feature)",
    "metric_matrix": f"with {DAYS} " + " union all ".join(matrix_row(a, b) for a in ("n", "mean") for b in ("n", "mean")),
    "graph_paths": f"with recursive {EDGES}, e9 as (select night, ch_i, ch_j, round(value, 9) as value from ed), no as (select night, ch_i as a from e9 union select night, ch_j from e9), en as (select night, abs(value) as v from e9 union all select night, abs(value) from e9 union all select night, 0 from no), th as (select night, quantile_cont(v, 0.6) as t from en group by night), bo as (select e9.night, ch_i as a, ch_j as b from e9 join th using (night) where abs(value) > t union all select e9.night, ch_j, ch_i from e9 join th using (night) where abs(value) > t), wk(night, a, b, d) as (select distinct night, a, a, 0 from bo union select w.night, w.a, bo.b, w.d + 1 from wk w join bo on bo.night = w.night and bo.a = w.b where w.d < 6), ds as (select night, a, b, min(d) as d from wk group by all), cz as (select night, a, count(*) as n, sum(d) as total, min(b) as root from ds group by night, a), cm as (select night, root, max(n) as n, sum(total) as total from cz group by night, root), bs as (select *, row_number() over (partition by night order by n desc, root) as k from cm) select night, cast(n as integer) as largest, round(total / (n * (n - 1))::double, 6) + 0.0 as path_length from bs where k = 1",
    "welch_window_bands": f"with {SEG}, w as (select epoch, cast(i // 30 as integer) as win, i % 30 as i, v from x where i < 60), c as (select epoch, win, i, (v - avg(v) over (partition by epoch, win)) * (0.5 - 0.5 * cos(2 * pi() * i / 30)) as v from w), b as (select epoch, win, i, v, unnest(range(0, 16)) as k from c), p as (select epoch, win, k, k * 64 / 30.0::double as f, (power(sum(v * cos(2 * pi() * k * i / 30)), 2) + power(sum(v * sin(2 * pi() * k * i / 30)), 2)) * case when k in (0, 15) then 1 else 2 end as p from b group by epoch, win, k), s as (select epoch, win, "
    + ", ".join(f"coalesce(sum(p) filter (f between {a} and {b}), 0) as {n}" for n, a, b in (("delta", 0.5, 4), ("theta", 4, 8), ("alpha", 8, 13), ("beta", 13, 30), ("gamma", 30, 45)))
    + " from p group by epoch, win) select epoch, win, " + ", ".join(f"round({c} / (delta + theta + alpha + beta + gamma), 6) + 0.0 as {c}" for c in ("delta", "theta", "alpha", "beta", "gamma")) + " from s",
    "granger_pair_f": f"with {CHANNELS}, t as (select a.night, a.epoch, a.channel as source, b.channel as target, a.t, b.v as y, lag(b.v) over w as y1, lag(a.v) over w as x1 from cx a join cx b on a.night = b.night and a.epoch = b.epoch and a.t = b.t and a.channel <> b.channel window w as (partition by a.night, a.epoch, a.channel, b.channel order by a.t)), u as (select * from t where y1 is not null), g as (select night, epoch, source, target, count(*) as n, regr_slope(y, y1) as c1, regr_intercept(y, y1) as c0, regr_slope(x1, y1) as d1, regr_intercept(x1, y1) as d0 from u group by all), e as (select u.night, u.epoch, u.source, u.target, max(g.n) as n, sum(power(y - c0 - c1 * y1, 2)) as r, power(sum((y - c0 - c1 * y1) * (x1 - d0 - d1 * y1)), 2) / sum(power(x1 - d0 - d1 * y1, 2)) as won from u join g using (night, epoch, source, target) group by all) select night, epoch, source, target, round(won / ((r - won) / (n - 3)), 6) + 0.0 as f from e",
    "cross_correlation_edges": f"with {CHANNELS} select a.night, a.epoch, a.channel as ch_i, b.channel as ch_j, round(corr(a.v, b.v), 6) + 0.0 as value from cx a join cx b on a.night = b.night and a.epoch = b.epoch and a.t = b.t and a.channel < b.channel group by 1, 2, 3, 4",
    "region_correlation_edges": f"with {CHANNELS}, rg as (select night, epoch, t, case when channel in ('E1', 'E2') then 'front' when channel in ('E3', 'E4') then 'back' else 'top' end as channel, avg(v) as v from cx group by 1, 2, 3, 4) select a.night, a.epoch, a.channel as ch_i, b.channel as ch_j, round(corr(a.v, b.v), 6) + 0.0 as value from rg a join rg b on a.night = b.night and a.epoch = b.epoch and a.t = b.t and a.channel < b.channel group by 1, 2, 3, 4",
    "half_rate_segments": f"with {SEG}, b as (select epoch, n, i, v, unnest(range(0, 17)) as k from x), sp as (select epoch, k, sum(v * cos(2 * pi() * k * i / n)) / 64 as re, -sum(v * sin(2 * pi() * k * i / n)) / 64 as im from b group by epoch, k), o as (select *, unnest(range(0, 32)) as m from sp) select epoch, cast(m as integer) as i, round(sum(case when k in (0, 16) then re * cos(2 * pi() * k * m / 32) else 2 * (re * cos(2 * pi() * k * m / 32) - im * sin(2 * pi() * k * m / 32)) end), 6) + 0.0 as v from o group by epoch, m",
}

RECORDED = """rv as (select *, row_number() over (partition by label order by vec_id) - 1 as place, count(*) over (partition by label) as n from embeddings),
  rp as (select label, place, case when place < n // 3 then 'a' else 'b' end as suffix, case when place < n // 3 then place else place - n // 3 end as epoch, unnest(range(0, 4)) as c, embedding from rv),
  re as (select cast(label as integer) as night, suffix, 'AUX' || c as channel, cast(epoch as integer) as epoch, cast(epoch * 16 as bigint) as first_sample, cast(place * 16 as bigint) as night_sample,
         list_sum([cast(embedding[4 * i + c + 1] as double) for i in range(16)]) as total, cast(embedding[c + 1] as double) as x from rp)"""

ORACLE |= {
    "recordings_load": f"with {RECORDED} select night, suffix, channel, count(*) as epochs, max(night_sample) as last, round(sum(total * night_sample), 3) as weighed from re group by all",
    "recordings_range": f"with {RECORDED} select night, epoch, first_sample, night_sample, round(total, 6) + 0.0 as total from re where channel = 'AUX1' and suffix = 'b' and first_sample >= 32 and first_sample < 480",
    "recordings_stream": f"with {RECORDED} select night, suffix, channel, count(*) as epochs, cast(sum(first_sample) as bigint) as places, round(sum(x), 4) as x from re group by all",
    "feature_bundle_written": f"with {NIGHTS} select night, count(*) as n, round(sum(price), 2) as price, 'price' as channel from fn group by night",
}

LONG = """lp as (select label as night, row_number() over (partition by label order by vec_id) - 1 as place, embedding from embeddings),
  ls as (select night, place // 16 as epoch, (place % 16) * 64 + unnest(range(0, 64)) as i, cast(unnest(embedding) as double) as v from lp),
  lr as (select night, epoch, count(*) as n, 0.2 * stddev_pop(v) as r from ls group by all),
  lt as (select night, epoch, i, v as a, lead(v) over w as b, lead(v, 2) over w as c from ls window w as (partition by night, epoch order by i)),
  lm as (select t.night, t.epoch, t.i, any_value(n) as n, any_value(t.c) as c, count(*) as le2, count(*) filter (where abs(t.a - u.a) < r and abs(t.b - u.b) < r and t.c is not null and u.c is not null and t.i <> u.i) as lt2,
           count(*) filter (where abs(t.c - u.c) <= r) as le3, count(*) filter (where abs(t.a - u.a) < r and abs(t.b - u.b) < r and abs(t.c - u.c) < r and t.i <> u.i) as lt3
         from lt t join lr on lr.night = t.night and lr.epoch = t.epoch join lt u on t.night = u.night and t.epoch = u.epoch and abs(t.a - u.a) <= r and abs(t.b - u.b) <= r
         where t.b is not null and u.b is not null group by t.night, t.epoch, t.i)"""

ORACLE["long_epoch_entropies"] = f"with {LONG} select night, cast(epoch as integer) as epoch, round(-ln(sum(lt3) / sum(lt2)), 6) + 0.0 as sample_entropy, round(avg(ln(le2 / (n - 1))) - avg(case when c is not null then ln(greatest(le3, 1) / (n - 2)) end), 6) + 0.0 as approximate_entropy from lm group by night, epoch"

RECURRENT = f"""{SEG}, qt as (select epoch, i, v as a, lead(v) over w as b, lead(v, 2) over w as c from x window w as (partition by epoch order by i)),
  qp as (select t.epoch, t.i, u.i as j, sqrt((t.a - u.a) * (t.a - u.a) + (t.b - u.b) * (t.b - u.b) + (t.c - u.c) * (t.c - u.c)) as d from qt t join qt u on t.epoch = u.epoch and t.c is not null and u.c is not null),
  qw as (select epoch, count(distinct i) as n, max(d) as w from qp group by epoch),
  qn as (select p.epoch, i, j from qp p join qw on qw.epoch = p.epoch where i <> j and d <= 0.3 * w),
  ql as (select epoch, i, 'diagonal' as kind, j - i as line from qn union all select epoch, i, 'vertical', j from qn),
  qr as (select *, i - row_number() over (partition by epoch, kind, line order by i) as run from ql),
  qc as (select epoch, kind, count(*) as length from qr group by epoch, kind, line, run),
  qs as (select epoch, sum(length) filter (where kind = 'diagonal') as points, sum(length) filter (where kind = 'diagonal' and length > 1) as dp, count(*) filter (where kind = 'diagonal' and length > 1) as dn,
           sum(length) filter (where kind = 'vertical' and length > 1) as vp, count(*) filter (where kind = 'vertical' and length > 1) as vn, cast(max(length) filter (where kind = 'diagonal' and length > 1) as bigint) as longest from qc group by epoch),
  qe as (select c.epoch, -sum(k / dn * ln(k / dn)) as entropy from (select epoch, length, count(*) as k from qc where kind = 'diagonal' and length > 1 group by all) c join qs on qs.epoch = c.epoch group by c.epoch)"""

ORACLE["recurrence_lines"] = f"with {RECURRENT} select qw.epoch, qw.n, round(coalesce(points, 0) / (n * (n - 1)), 6) + 0.0 as rate, round(coalesce(dp, 0) / points, 6) + 0.0 as determinism, round(coalesce(vp, 0) / points, 6) + 0.0 as laminarity, round(dp / dn, 6) + 0.0 as mean_length, round(vp / vn, 6) + 0.0 as trapping, round(entropy, 6) + 0.0 as entropy, longest from qw left join qs on qs.epoch = qw.epoch left join qe on qe.epoch = qw.epoch"

BITS24 = """db as (select 'label-' || label || '.bdf' as recording, row_number() over (partition by label order by vec_id) - 1 as record, [round((cast(v as double) + 1) / (2.0::double / 16777215)) * (2.0::double / 16777215) - 1 for v in embedding] as s from embeddings),
  dc as (select recording, record, unnest(range(0, 3)) as c, s from db)"""

ORACLE["record_interleaved_load"] = f"with {BITS24} select recording, chr(cast(65 + c as integer)) as channel, record, record * 16 as first_sample, 64.0::double as sfreq, 16 as n, round(s[16 * c + 1], 6) + 0.0 as x, round(list_sum(s[16 * c + 1:16 * c + 16]), 6) + 0.0 as total from dc"
