"""The same six tables as Spark SQL text over a view of observations.

templates(view, cfg) gives name -> SQL. Views: `obs` columns as in metric_tables. The DataFrame
plans and these agree row by row; tests hold them against one another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..config import Config
from ..operators.reliability import WITHIN


def ratio(n: str, d: str) -> str:
    return f"coalesce(try_divide(cast({n} as double), cast({d} as double)), 0d)"


def days(a: str, b: str) -> str:
    return f"timestampdiff(MICROSECOND, {a}, {b}) / 86400000000d"


def templates(obs: str, entities: str, cfg: Config, within=WITHIN) -> dict[str, str]:
    h = cfg.horizon_days
    waits = f"""
      with events as (select aoi_id, observed_at as at, 1 as is_event, observed_at as event from {obs} where complete and usable),
      starts as (select aoi_id, cast(d as timestamp) as at, 0 as is_event, cast(null as timestamp) as event from {entities}
        lateral view explode(sequence(date'{cfg.start}', date_sub(date'{cfg.end}', {h}))) s as d),
      ahead as (select *, last_value(event) ignore nulls over (partition by aoi_id order by at desc, is_event desc
        rows between unbounded preceding and current row) as next from (select * from starts union all select aoi_id, cast(at as timestamp), is_event, cast(event as timestamp) from events)),
      measured as (select aoi_id, at as t0, {days('at', 'next')} as w from ahead where is_event = 0)
      select aoi_id, t0, if(w is null or w > {h}, {h}d, w) as wait_days, (w is null or w > {h}) as censored from measured"""
    gaps = f"""
      with line as (select aoi_id, observed_at, datatake_id, kind from {obs}
        lateral view explode(if(usable, array('nominal', 'effective'), array('nominal'))) k as kind where complete),
      paired as (select aoi_id, kind, lag(observed_at) over (partition by aoi_id, kind order by observed_at, datatake_id) as gap_start,
        observed_at as gap_end from line)
      select *, {days('gap_start', 'gap_end')} as gap_days from paired where gap_start is not null"""
    survival = f"""
      select e.aoi_id, n as n_days, {ratio('count_if(w.wait_days > n)', 'count(w.t0)')} as p_waiting
      from (select aoi_id, n from {entities} lateral view explode(sequence(0, {h})) s as n) e
      left join ({waits}) w on w.aoi_id = e.aoi_id group by e.aoi_id, n"""
    monthly = f"""
      select e.aoi_id, m as month, {', '.join(f"coalesce(avg(cast(w.wait_days <= {k} as double)), 0d) as p_within_{k}d" for k in (5, 7, 14))}, count(w.t0) as n_days
      from (select aoi_id, m from {entities} lateral view explode(sequence(1, 12)) s as m) e
      left join (select *, month(t0) as mm from ({waits})) w on w.aoi_id = e.aoi_id and w.mm = e.m group by e.aoi_id, m"""
    hit = "coalesce(o.catalog_cloud_cover <= s.threshold, false)"
    confusion = f"""
      with scopes as (select aoi_id, threshold from (select aoi_id from {entities} union all select 'ALL')
        lateral view explode(sequence(0, 100, 5)) t as threshold),
      o as (select * from {obs} where complete),
      cells as (select s.aoi_id, s.threshold, {', '.join(f"count_if(o.datatake_id is not null and {c}) as {k}" for k, c in
        (("tp", f"o.usable and {hit}"), ("fp", f"not o.usable and {hit}"), ("fn", f"o.usable and not {hit}"), ("tn", f"not o.usable and not {hit}")))}
        from scopes s left join (select aoi_id as scope, * from o union all select 'ALL' as scope, * from o) o on o.scope = s.aoi_id group by s.aoi_id, s.threshold),
      rated as (select *, {ratio('tp', 'tp + fp')} as precision, {ratio('tp', 'tp + fn')} as recall from cells)
      select *, {ratio('2d * precision * recall', 'precision + recall')} as f1, {ratio('fp', 'tp + fp')} as kept_unusable_rate,
        {ratio('fn', 'tp + fn')} as discarded_usable_rate from rated"""
    eff = "kind = 'effective'"
    summary = f"""
      with c as (select e.aoi_id, count_if(complete) as n_observations, count_if(complete and usable) as n_usable
        from {entities} e left join {obs} o on o.aoi_id = e.aoi_id group by e.aoi_id),
      g as (select aoi_id, median(gap_days) filter (where kind = 'nominal') as nominal_median_gap_days, median(gap_days) filter (where {eff}) as effective_median_gap_days,
        percentile(gap_days, 0.9d) filter (where {eff}) as effective_p90_gap_days, max(gap_days) filter (where {eff}) as longest_outage_days,
        count_if({eff} and gap_days > 30) as n_outages_over_30d from ({gaps}) group by aoi_id),
      s as (select aoi_id, {', '.join(f"max(1.0d - p_waiting) filter (where n_days = {n}) as p_within_{n}d" for n in within)} from ({survival}) group by aoi_id),
      m as (select aoi_id, max_by(month, struct(p_within_7d, -month)) as best_month, min_by(month, struct(p_within_7d, month)) as worst_month,
        max(p_within_7d) as hi, min(p_within_7d) as lo from ({monthly}) where n_days > 0 group by aoi_id),
      t as (select aoi_id, precision, recall from ({confusion}) where threshold = 20)
      select c.aoi_id, n_observations, n_usable, {ratio('n_usable', 'n_observations')} as usable_rate,
        {', '.join(f"coalesce(g.{k}, 0d) as {k}" for k in ('nominal_median_gap_days', 'effective_median_gap_days', 'effective_p90_gap_days', 'longest_outage_days'))},
        coalesce(g.n_outages_over_30d, 0) as n_outages_over_30d, {', '.join(f"coalesce(s.p_within_{n}d, 0d) as p_within_{n}d" for n in within)},
        coalesce(best_month, 0) as best_month, coalesce(worst_month, 0) as worst_month, coalesce(hi, 0d) as p_within_7d_best_month,
        coalesce(lo, 0d) as p_within_7d_worst_month, t.precision as catalog_filter_precision_t20, t.recall as catalog_filter_recall_t20
      from c left join g on g.aoi_id = c.aoi_id left join s on s.aoi_id = c.aoi_id left join m on m.aoi_id = c.aoi_id left join t on t.aoi_id = c.aoi_id"""
    return {"aoi_wait_daily": waits, "aoi_gaps": gaps, "aoi_survival": survival, "aoi_monthly": monthly, "catalog_filter_eval": confusion, "aoi_summary": summary}


def sql_table(spark: SparkSession, name: str, obs: DataFrame, entities: DataFrame, cfg: Config, within=WITHIN) -> DataFrame:
    obs.createOrReplaceTempView("sql_obs")
    entities.createOrReplaceTempView("sql_entities")
    return spark.sql(templates("sql_obs", "sql_entities", cfg, within)[name])
