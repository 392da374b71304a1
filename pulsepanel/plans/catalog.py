"""Registered queries: one per operator of the inventory, each with the
equivalent DuckDB SQL where SQL can express it.

Every query reads the test tables (or panels Spark derives from them) in
full.  Doubles are rounded to 6 decimals on both sides so summation order
cannot flip the value hash; integer counts are BIGINT on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsepanel.functions import periods as P
from pulsepanel.functions import scalar as S
from pulsepanel.operators import binning, clean, joins, labels, metrics, panel, prep, profile
from pulsepanel.operators import rank, sample, scenario, segment
from pulsepanel.plans import fixtures as fx
from pulsepanel.session import checkpoint_dir
from pulsepanel.sources import mixed, tables
from pulsepanel.sources.bucketed import by_bucket, write_bucketed
from pulsepanel.sources.sinks import (
    materialize, read_report_csv, write_json_summary, write_parquet, write_report_csv,
)
from pulsepanel.sources.tables import require_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def r6(df: DataFrame) -> DataFrame:
    """Round every double column to 6 decimals (value-hash stability)."""
    return df.select([F.round(F.col(f.name), 6).alias(f.name)
                      if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                      for f in df.schema.fields])


# ----------------------------------------------------------------- SQL CTEs
SP = f"sp as ({fx.SQL_SUPPLIER_PANEL})"
RP = f"rp as ({fx.SQL_RETURNS_PANEL})"
CP = f"cp as ({fx.SQL_CENSORED_PANEL})"
OT = f"ot as ({fx.SQL_ORDER_TXN})"
UL = f"ul as ({fx.SQL_USAGE_LOGS})"
MR = f"mr as ({fx.SQL_MEMBER_ROWS})"
MA = f"ma as ({fx.SQL_MEMBER_ATTRS})"
SF = f"sf as ({fx.SQL_SCORE_FRAME})"
SG = f"sg as ({fx.SQL_SEGMENT_FRAME})"

# Censored panel with lag-1 / diff-1 and the status three months later.
CX = CP + """,
cx as (
  select a.msno, a.safra, a.month_idx, a.n_lines, a.qty, a.price_cents, a.n_returned,
         cast(coalesce(a.is_ativo, 0) as integer) as is_ativo,
         cast(p.n_lines as double) as n_lines_lag1, cast(p.qty as double) as qty_lag1,
         cast(p.price_cents as double) as price_cents_lag1,
         cast(p.n_returned as double) as n_returned_lag1,
         a.n_lines - cast(p.n_lines as double) as n_lines_diff1,
         a.qty - cast(p.qty as double) as qty_diff1,
         a.price_cents - cast(p.price_cents as double) as price_cents_diff1,
         a.n_returned - cast(p.n_returned as double) as n_returned_diff1,
         case when f.msno is null then null
              else cast(coalesce(f.is_ativo, 0) as integer) end as is_ativo_fut
  from cp a
  left join cp p on p.msno = a.msno and p.month_idx = a.month_idx - 1
  left join cp f on f.msno = a.msno and f.month_idx = a.month_idx + 3
)"""

DIAG = CX + """,
dg as (
  select safra, max(month_idx) as idx,
         count(is_ativo_fut) as obs,
         count(case when is_ativo_fut is not null and is_ativo = 1 then 1 end) as elig,
         sum(is_ativo_fut) as fut_sum,
         count(case when is_ativo_fut = 0 and is_ativo = 1 then 1 end) as churn
  from cx group by safra
),
diag as (
  select safra,
         cast(case when obs = 0 then 0 when elig = 0 then obs else elig end as bigint) as rows,
         case when obs > 0 then fut_sum::double / obs else 0.0::double end as fut_active_rate,
         case when elig > 0 then churn::double / elig else 0.0::double end as churn_rate,
         case when obs = 0 or elig = 0 then 0
              when (case when obs > 0 then fut_sum::double / obs else 0.0 end) < 0.01
                or (case when elig > 0 then churn::double / elig else 0.0 end) > 0.95 then 0
              else 1 end as label_trust
  from dg where idx + 3 <= (select max(idx) from dg)
)"""

MODEL = DIAG + """,
mt as (
  select cx.*, cast(case when cx.is_ativo = 1 and cx.is_ativo_fut = 0 then 1 else 0 end as integer) as churn_3m,
         cast(coalesce(d.label_trust, 0) as integer) as label_trust,
         d.fut_active_rate, d.churn_rate as churn_rate_month
  from cx left join diag d on d.safra = cx.safra
  where cx.is_ativo_fut is not null
)"""

ELIG = MODEL + """,
el as (select * from mt where is_ativo = 1 and label_trust = 1)"""

LAG_COLS = ["n_lines", "qty", "price_cents", "n_returned"]


def _model(spark, d):
    return labels.model_table(fx.censored_panel(spark, d), LAG_COLS)


def _diag(spark, d):
    x = labels.forward_status(fx.censored_panel(spark, d), idx="month_idx")
    return labels.label_trust(x, idx="month_idx")


def _features(spark, d):
    return panel.feature_join(fx.supplier_panel(spark, d), [fx.returns_panel(spark, d)],
                              paid_col="returned_cents", usage_col="qty")


FEAT = SP + ",\n" + RP + """,
ft as (
  select sp.*, rp.returned_cents, rp.ret_lines, rp.max_tax,
         cast(coalesce(rp.returned_cents, 0) > 0 as integer) as has_payment,
         cast(coalesce(sp.qty, 0) > 0 as integer) as has_usage
  from sp left join rp on rp.msno = sp.msno and rp.safra = sp.safra
)"""

# =========================================================== 2.1 scans


@query("scan_projected", """
select l_orderkey, l_linenumber, l_suppkey, l_quantity, l_returnflag, 0.0::double as num_unq
from lineitem
""")
def q_scan_projected(spark, d):
    # wanted ∩ existing columns; an absent measure gets its default
    return tables.read_table(
        spark, f"{d}/lineitem.parquet",
        ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_returnflag",
         "l_not_there", "num_unq"], defaults={"num_unq": 0.0})


@query("scan_month_filter", """
select l_orderkey, l_linenumber, l_suppkey,
       cast(year(l_shipdate)*100 + month(l_shipdate) as integer) as safra
from lineitem
where year(l_shipdate)*100 + month(l_shipdate) in (199601, 199602, 199812)
""")
def q_scan_month_filter(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    cond = tables.timestamp_period_filter("l_shipdate", [199601, 199602, 199812])
    return li.where(cond).select("l_orderkey", "l_linenumber", "l_suppkey",
                                 P.period_of_timestamp("l_shipdate").alias("safra"))


@query("period_list", f"with {SP} select distinct safra from sp")
def q_period_list(spark, d):
    return tables.period_list(fx.supplier_panel(spark, d), "safra")


@query("period_coverage", f"""
with {SP}
select min(safra) as period_min, max(safra) as period_max,
       count(distinct safra) as n_periods, count(*) as rows from sp
""")
def q_period_coverage(spark, d):
    return profile.period_coverage(fx.supplier_panel(spark, d))


@query("sample_head", f"""
with {SP}
select * from sp order by msno, safra limit 100
""")
def q_sample_head(spark, d):
    return fx.supplier_panel(spark, d).orderBy("msno", "safra").limit(100)


# =========================================================== 2.2 projections


@query("coerce_numeric", """
select event_id,
       try_cast(regexp_extract(props, ':\\s*([^}]*)', 1) as double) as k_num,
       try_cast(event_type as double) as type_num
from events
""")
def q_coerce_numeric(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id",
                    S.coerce_numeric(F.regexp_extract("props", r":\s*([^}]*)", 1)).alias("k_num"),
                    S.coerce_numeric(F.col("event_type")).alias("type_num"))


@query("normalize_keys", """
select cast(o_custkey as varchar) as msno,
       cast(strftime(o_orderdate, '%Y%m') as integer) as safra, o_orderkey
from orders
""")
def q_normalize_keys(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(
        F.col("o_custkey").alias("msno"), F.date_format("o_orderdate", "yyyyMM").alias("safra"),
        "o_orderkey")
    good, _rejected = clean.normalize_keys(o)
    return good


# The period as a double with gaps: what a nullable integer column becomes.
@query("normalize_keys_float", """
select cast(o_custkey as varchar) as msno,
       cast(strftime(o_orderdate, '%Y%m') as integer) as safra, o_orderkey
from orders where o_orderkey % 11 <> 0
""")
def q_normalize_keys_float(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(
        F.col("o_custkey").alias("msno"),
        F.when(F.col("o_orderkey") % 11 != 0, F.date_format("o_orderdate", "yyyyMM").cast("double"))
        .alias("safra"), "o_orderkey")
    good, _rejected = clean.normalize_keys(o)
    return good


@query("row_sum", f"""
with {UL}
select event_id, msno, safra, num_25 + num_50 + num_75 + num_985 + num_100 as plays_total from ul
""")
def q_row_sum(spark, d):
    ul = fx.usage_logs(spark, d)
    return ul.select("event_id", "msno", "safra", S.row_sum(panel.PLAY_BUCKETS).alias("plays_total"))


@query("weighted_completion", f"""
with {UL}
select event_id, round(0.25*num_25 + 0.5*num_50 + 0.75*num_75 + 0.985*num_985 + 1.0*num_100, 6)
       as completion_num from ul
""")
def q_weighted_completion(spark, d):
    ul = fx.usage_logs(spark, d)
    return r6(ul.select("event_id", S.weighted_sum(panel.COMPLETION_WEIGHTS).alias("completion_num")))


@query("safe_ratio", """
select c_custkey as msno,
       round(case when c_nationkey > 0 then c_acctbal / c_nationkey end, 6) as bal_per_nation
from customer
""")
def q_safe_ratio(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    return r6(c.select(F.col("c_custkey").alias("msno"),
                       S.safe_ratio("c_acctbal", "c_nationkey").alias("bal_per_nation")))


@query("activity_flags", f"""
with {FEAT}
select msno, safra, has_payment, has_usage from ft
""")
def q_activity_flags(spark, d):
    return _features(spark, d).select("msno", "safra", "has_payment", "has_usage")


@query("null_out_of_range", f"""
with {MA}
select msno, case when bd between 10 and 90 then bd end as bd from ma
""")
def q_null_out_of_range(spark, d):
    ma = fx.member_attrs(spark, d)
    return ma.select("msno", S.null_out_of_range("bd", 10, 90).alias("bd"))


@query("clip_shift", f"""
with {MA}
select msno, case when bd between 10 and 90 then greatest(bd - 50, 0) + 1 end as bd_shift from ma
""")
def q_clip_shift(spark, d):
    ma = fx.member_attrs(spark, d)
    return ma.select("msno", S.clip_shift(S.null_out_of_range("bd", 10, 90) - 50).alias("bd_shift"))


@query("trend_bins", f"""
with {ELIG},
b as (select case when coalesce(n_returned_diff1, 0) <= -1 then 'Queda'
                  when coalesce(n_returned_diff1, 0) <= 1 then 'Estável'
                  else 'Alta' end as paid_trend, churn_3m from el)
select paid_trend, round(avg(churn_3m::double), 6) as churn_rate, count(*) as n
from b group by paid_trend
""")
def q_trend_bins(spark, d):
    el = labels.eligible_trusted(_model(spark, d))
    b = el.withColumn("paid_trend", S.trend_bin("n_returned_diff1"))
    return r6(binning.rate_by_bin(b, "paid_trend", "churn_3m"))


@query("age_groups", f"""
with {MA},
b as (select case when bd > 10 and bd <= 20 then '10-20' when bd > 20 and bd <= 30 then '21-30'
                  when bd > 30 and bd <= 40 then '31-40' when bd > 40 and bd <= 50 then '41-50'
                  when bd > 50 and bd <= 60 then '51-60' when bd > 60 and bd <= 90 then '61+' end
             as age_group, gender
      from ma where bd between 10 and 90)
select age_group, round(avg(case when gender = 'AUTOMOBILE' then 1.0 else 0.0 end), 6) as churn_rate,
       count(*) as n
from b where age_group is not null group by age_group
""")
def q_age_groups(spark, d):
    ma = fx.member_attrs(spark, d).where(F.col("bd").between(10, 90))
    b = ma.select(S.age_group("bd").alias("age_group"),
                  (F.col("gender") == "AUTOMOBILE").cast("int").alias("target"))
    return r6(binning.rate_by_bin(b, "age_group", "target"))


QBIN_SQL = """
e as (select list_sort(list_distinct(quantile_cont(v, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) as edges
      from src),
b as (select src.*, len(e.edges) - 1 as nb,
             1 + len(list_filter(e.edges[2:len(e.edges) - 1], lambda x: x < src.v)) as bi
      from src, e),
lab as (select *, case when nb <= 1 then 'Faixa única' when bi = 1 then 'Q1(menor)'
                       when bi = nb then 'Q' || nb || '(maior)' else 'Q' || bi end as bin from b)
select bin, round(avg(y::double), 6) as churn_rate, count(*) as n from lab group by bin
"""


@query("quantile_bins", f"""
with {FEAT},
src as (select coalesce(max_tax, -1.0) as v, is_ativo as y from ft),
{QBIN_SQL}
""")
def q_quantile_bins(spark, d):
    ft = materialize(_features(spark, d).select("max_tax", "is_ativo"), "bin_rows")
    b = binning.quantile_bins(ft, "max_tax", q=5, fill=-1, out="bin")
    return r6(binning.rate_by_bin(b, "bin", "is_ativo"))


@query("rate_by_bin", f"""
with {ELIG},
src as (select case when qty_lag1 is not null then greatest(qty_lag1, 0) + 1 else 0.0 end as v,
               churn_3m as y from el),
{QBIN_SQL}
""")
def q_rate_by_bin(spark, d):
    el = labels.eligible_trusted(_model(spark, d))
    x = materialize(el.select(S.clip_shift("qty_lag1").alias("eng"), "churn_3m"), "bin_rows")
    b = binning.quantile_bins(x, "eng", q=5, fill=0, out="bin")
    return r6(binning.rate_by_bin(b, "bin", "churn_3m"))


@query("eligible_trusted", f"""
with {ELIG}
select msno, safra, churn_3m from el
""")
def q_eligible_trusted(spark, d):
    return labels.eligible_trusted(_model(spark, d)).select("msno", "safra", "churn_3m")


@query("semi_join_periods", f"""
with {DIAG}, {SP}
select msno, safra, n_lines from sp where safra in (select safra from diag where label_trust = 1)
""")
def q_semi_join_periods(spark, d):
    trusted = _diag(spark, d).where(F.col("label_trust") == 1)
    return joins.semi_join_periods(fx.supplier_panel(spark, d), trusted).select(
        "msno", "safra", "n_lines")


@query("suspect_periods", f"""
with {DIAG}
select safra, rows, round(fut_active_rate, 6) as fut_active_rate, round(churn_rate, 6) as churn_rate
from diag where label_trust = 0
""")
def q_suspect_periods(spark, d):
    dg = _diag(spark, d)
    return r6(dg.where(F.col("label_trust") == 0).select("safra", "rows", "fut_active_rate",
                                                          "churn_rate").orderBy("safra"))


@query("confusion_flags", f"""
with {SF}, t as (select quantile_cont(p_churn, 0.95) as thr from sf)
select msno, safra, cast(p_churn >= thr as integer) as pred_action,
       cast(p_churn >= thr and churn_3m = 0 as integer) as fp,
       cast(p_churn < thr and churn_3m = 1 as integer) as fn
from sf, t
""")
def q_confusion_flags(spark, d):
    sf = metrics.reusable(fx.score_frame(spark, d), ["msno", "safra", "p_churn", "churn_3m"])
    thr = rank.exact_quantiles(sf, "p_churn", [0.95])[0.95]
    return segment.confusion_flags(sf, thr).select("msno", "safra", "pred_action", "fp", "fn")


# =========================================================== 2.3 joins


@query("feature_join", f"""
with {FEAT}
select msno, safra, month_idx, n_lines, qty, price_cents, n_returned, is_ativo,
       returned_cents, ret_lines, max_tax, has_payment, has_usage from ft
""")
def q_feature_join(spark, d):
    return _features(spark, d)


ORDER_PANEL = OT + """,
op as (
  select msno, safra, sum(actual_amount_paid) as paid_sum, sum(is_cancel) as cancel_txn_count,
         avg(coalesce(plan_list_price, 0.0)) as plan_price_mean,
         avg(coalesce(payment_plan_days, 0.0)) as plan_days_mean,
         avg(coalesce(is_auto_renew, 0.0)) as auto_renew_rate
  from ot where msno is not null and safra is not null group by msno, safra
),
opi as (select *, cast((safra // 100) * 12 + safra % 100 - 1 as integer) as mi from op)"""


def _order_panel(spark, d):
    return panel.payments_monthly(fx.order_txn(spark, d))


@query("lag1_diff1", f"""
with {ORDER_PANEL}
select a.msno, a.safra,
       round(p.paid_sum, 6) as paid_sum_lag1, round(a.paid_sum - p.paid_sum, 6) as paid_sum_diff1,
       round(p.cancel_txn_count, 6) as cancel_txn_count_lag1,
       round(a.cancel_txn_count - p.cancel_txn_count, 6) as cancel_txn_count_diff1,
       round(p.auto_renew_rate, 6) as auto_renew_rate_lag1,
       round(a.auto_renew_rate - p.auto_renew_rate, 6) as auto_renew_rate_diff1
from opi a left join opi p on p.msno = a.msno and p.mi = a.mi - 1
""")
def q_lag1_diff1(spark, d):
    cols = ["paid_sum", "cancel_txn_count", "auto_renew_rate"]
    out = panel.lag_diff(_order_panel(spark, d), cols)
    return r6(out.select("msno", "safra", *[f"{c}_{s}" for c in cols for s in ("lag1", "diff1")]))


@query("forward_status", f"""
with {CX}
select msno, safra, is_ativo, is_ativo_fut from cx
""")
def q_forward_status(spark, d):
    x = labels.forward_status(fx.censored_panel(spark, d), idx="month_idx")
    return x.select("msno", "safra", "is_ativo", "is_ativo_fut")


@query("churn_label", f"""
with {CX}
select msno, safra, is_ativo, is_ativo_fut,
       cast(case when is_ativo = 1 and is_ativo_fut = 0 then 1 else 0 end as integer) as churn_3m
from cx where is_ativo_fut is not null
""")
def q_churn_label(spark, d):
    x = labels.churn_label(fx.censored_panel(spark, d), idx="month_idx")
    return x.select("msno", "safra", "is_ativo", "is_ativo_fut", "churn_3m")


@query("label_trust", f"""
with {DIAG}
select safra, rows, round(fut_active_rate, 6) as fut_active_rate, round(churn_rate, 6) as churn_rate,
       label_trust from diag
""")
def q_label_trust(spark, d):
    return r6(_diag(spark, d))


@query("attach_trust", f"""
with {MODEL}
select msno, safra, churn_3m, label_trust, round(fut_active_rate, 6) as fut_active_rate,
       round(churn_rate_month, 6) as churn_rate_month from mt
""")
def q_attach_trust(spark, d):
    # the panel with its forward status serves the rows and the diagnosis
    x = materialize(labels.forward_status(fx.censored_panel(spark, d), idx="month_idx"), "status")
    rows = labels.label_rows(x)
    out = labels.attach_trust(rows, labels.label_trust(x, idx="month_idx"))
    return r6(out.select("msno", "safra", "churn_3m", "label_trust", "fut_active_rate",
                         "churn_rate_month"))


@query("model_table", f"""
with {MODEL}
select msno, safra, month_idx, n_lines, qty, price_cents, n_returned, is_ativo,
       round(n_lines_lag1, 6) as n_lines_lag1, round(qty_lag1, 6) as qty_lag1,
       round(price_cents_lag1, 6) as price_cents_lag1, round(n_returned_lag1, 6) as n_returned_lag1,
       round(n_lines_diff1, 6) as n_lines_diff1, round(qty_diff1, 6) as qty_diff1,
       round(price_cents_diff1, 6) as price_cents_diff1,
       round(n_returned_diff1, 6) as n_returned_diff1,
       is_ativo_fut, churn_3m, label_trust, round(fut_active_rate, 6) as fut_active_rate,
       round(churn_rate_month, 6) as churn_rate_month
from mt
""")
def q_model_table(spark, d):
    return r6(_model(spark, d))


@query("refresh_model_table", ORACLES["model_table"])
def q_refresh_model_table(spark, d):
    """The model table of a store that was built without its last two months and
    with a wrong month, and then refreshed with the three."""
    from pulsepanel.operators.refresh import PanelStore

    features = materialize(fx.censored_panel(spark, d), "features")
    months = sorted(r.safra for r in tables.period_list(features, "safra").collect())
    fixed, late = months[len(months) // 2], months[-2:]
    store = PanelStore(_scratch(spark, "store"), LAG_COLS)
    wrong = F.col("safra") == fixed
    store.build(features.where(~F.col("safra").isin(late))
                .withColumn("qty", F.when(wrong, F.col("qty") + 1).otherwise(F.col("qty")))
                .withColumn("is_ativo", F.when(wrong, 1 - F.col("is_ativo")).otherwise(F.col("is_ativo"))))
    for changed in ([fixed], late):
        store.refresh(features.where(F.col("safra").isin(changed)), changed)
    return r6(store.read(spark))


@query("join_one_to_one", f"""
with {SG}, {SP}
select sg.msno, sg.safra, sg.p_churn, sg.churn_3m, sp.n_lines, sp.qty
from sg join sp on sp.msno = sg.msno and sp.safra = sg.safra
""")
def q_join_one_to_one(spark, d):
    sg = fx.segment_frame(spark, d).select("msno", "safra", "p_churn", "churn_3m")
    sp = fx.supplier_panel(spark, d).select("msno", "safra", "n_lines", "qty")
    return joins.join_one_to_one(sg, sp, ["msno", "safra"])


@query("attach_trust_broadcast", f"""
with {MODEL}
select safra, count(*) as rows, cast(sum(label_trust) as bigint) as trusted_rows from mt group by safra
""")
def q_attach_trust_broadcast(spark, d):
    m = _model(spark, d)
    return m.groupBy("safra").agg(F.count(F.lit(1)).alias("rows"),
                                  F.sum("label_trust").cast("bigint").alias("trusted_rows"))


# =========================================================== 2.4 aggregations


@query("usage_monthly", f"""
with {UL},
g as (select msno, safra, sum(num_unq) as num_unq, sum(total_secs) as total_secs,
             sum(num_25 + num_50 + num_75 + num_985 + num_100) as plays_total,
             sum(num_25) as num_25, sum(num_50) as num_50, sum(num_75) as num_75,
             sum(num_985) as num_985, sum(num_100) as num_100,
             sum(0.25*num_25 + 0.5*num_50 + 0.75*num_75 + 0.985*num_985 + 1.0*num_100) as cn
      from ul group by msno, safra)
select msno, safra, num_unq, total_secs, plays_total, num_25, num_50, num_75, num_985, num_100,
       round(case when plays_total > 0 then cn / plays_total end, 6) as completion_rate,
       round(case when plays_total > 0 then total_secs / plays_total end, 6) as secs_per_play
from g
""")
def q_usage_monthly(spark, d):
    return r6(panel.usage_monthly(fx.usage_logs(spark, d)))


@query("payments_monthly", f"""
with {ORDER_PANEL}
select msno, safra, round(paid_sum, 6) as paid_sum, round(cancel_txn_count, 6) as cancel_txn_count,
       round(plan_price_mean, 6) as plan_price_mean, round(plan_days_mean, 6) as plan_days_mean,
       round(auto_renew_rate, 6) as auto_renew_rate
from op
""")
def q_payments_monthly(spark, d):
    return r6(_order_panel(spark, d))


@query("members_monthly", f"""
with {MR}
select msno, safra,
       arg_min(city, _ord) filter (where city is not null) as city,
       arg_min(bd, _ord) filter (where bd between 10 and 90) as bd,
       arg_min(gender, _ord) filter (where gender is not null) as gender,
       arg_min(registered_via, _ord) filter (where registered_via is not null) as registered_via,
       max(is_ativo) as is_ativo
from mr group by msno, safra
""")
def q_members_monthly(spark, d):
    return panel.members_monthly(fx.member_rows(spark, d))


@query("churn_by_period", f"""
with {ELIG}
select safra, count(*) as rows, round(avg(churn_3m::double), 6) as churn,
       cast(sum(churn_3m) as bigint) as churn_n
from el group by safra
""")
def q_churn_by_period(spark, d):
    el = labels.eligible_trusted(_model(spark, d))
    return r6(el.groupBy("safra").agg(F.count(F.lit(1)).alias("rows"),
                                      F.avg(F.col("churn_3m").cast("double")).alias("churn"),
                                      F.sum("churn_3m").cast("bigint").alias("churn_n")))


@query("base_rate", f"""
with {SF}
select count(*) as rows, round(avg(churn_3m::double), 6) as base_churn,
       cast(sum(churn_3m) as bigint) as churn_n from sf
""")
def q_base_rate(spark, d):
    sf = fx.score_frame(spark, d)
    return r6(sf.agg(F.count(F.lit(1)).alias("rows"),
                     F.avg(F.col("churn_3m").cast("double")).alias("base_churn"),
                     F.sum("churn_3m").cast("bigint").alias("churn_n")))


PROFILE_COLS = ["n_lines", "qty", "price_cents", "n_returned", "returned_cents", "ret_lines",
                "max_tax"]


def _profile_union(expr_fmt: str, cols) -> str:
    return "\nunion all\n".join(expr_fmt.format(c=c) for c in cols)


@query("missing_profile", f"""
with {FEAT},
m as ({_profile_union("select '{c}' as feature, avg(case when {c} is null then 1.0 else 0.0 end) * 100.0 as pct_missing from ft",
                      ["msno", "safra", "month_idx", *PROFILE_COLS, "is_ativo", "has_payment", "has_usage"])})
select feature, round(pct_missing, 6) as pct_missing from m where pct_missing > 0
""")
def q_missing_profile(spark, d):
    return r6(profile.missing_profile(_features(spark, d)))


@query("numeric_profile", f"""
with {FEAT},
m as ({_profile_union('''select '{c}' as feature, count({c}) as count, avg({c}::double) as mean,
      stddev_samp({c}::double) as std, min({c}::double) as min,
      quantile_cont({c}::double, [0.05, 0.25, 0.5, 0.75, 0.95]) as q, max({c}::double) as max from ft''',
                      PROFILE_COLS)})
select feature, count, round(mean, 6) as mean, round(std, 6) as std, round(min, 6) as min,
       round(q[1], 6) as p05, round(q[2], 6) as p25, round(q[3], 6) as p50,
       round(q[4], 6) as p75, round(q[5], 6) as p95, round(max, 6) as max
from m
""")
def q_numeric_profile(spark, d):
    return r6(profile.numeric_profile(_features(spark, d), PROFILE_COLS))


@query("target_correlation", f"""
with {FEAT},
m as ({_profile_union("select '{c}' as feature, corr({c}::double, is_ativo::double) as corr from ft",
                      PROFILE_COLS)})
select feature, round(corr, 6) as corr from m
""")
def q_target_correlation(spark, d):
    return r6(profile.target_correlation(_features(spark, d), "is_ativo", PROFILE_COLS))


SEG_FEAT = SG + ",\n" + SP + """,
sgf as (select sg.*, sp.n_lines, sp.qty, sp.price_cents, sp.n_returned
        from sg join sp on sp.msno = sg.msno and sp.safra = sg.safra),
thr as (select quantile_cont(p_churn, 0.95) as t from sgf),
sgc as (select sgf.*, cast(p_churn >= t and churn_3m = 0 as integer) as fp,
               cast(p_churn < t and churn_3m = 1 as integer) as fn from sgf, thr)"""


def _segment_features(spark, d):
    sg = fx.segment_frame(spark, d)
    sp = fx.supplier_panel(spark, d).select("msno", "safra", "n_lines", "qty", "price_cents",
                                             "n_returned")
    x = materialize(sg.join(sp, ["msno", "safra"], "inner"), "segment_rows")
    thr = rank.exact_quantiles(x, "p_churn", [0.95])[0.95]
    return segment.confusion_flags(x, thr)


@query("segment_profile", f"""
with {SEG_FEAT},
g as (select cluster, count(*) as rows, avg(p_churn) as p_churn, avg(churn_3m::double) as churn_3m,
             avg(fp::double) as fp, avg(fn::double) as fn, avg(qty::double) as qty
      from sgc group by cluster)
select cluster, rows, round(p_churn, 6) as p_churn, round(churn_3m, 6) as churn_3m,
       round(fp, 6) as fp, round(fn, 6) as fn, round(qty, 6) as qty,
       round(rows::double / sum(rows) over (), 6) as share
from g
""")
def q_segment_profile(spark, d):
    return r6(segment.segment_profile(_segment_features(spark, d), extra_means=["qty"]))


@query("segment_drivers", f"""
with {SEG_FEAT},
ov as ({_profile_union("select '{c}' as feature, var_samp({c}::double) as v from sgc",
                       ["n_lines", "qty", "price_cents", "n_returned"])}),
mn as (select cluster, avg(n_lines::double) as n_lines, avg(qty::double) as qty,
              avg(price_cents::double) as price_cents, avg(n_returned::double) as n_returned
       from sgc group by cluster),
bv as ({_profile_union("select '{c}' as feature, var_samp({c}) as v from mn",
                       ["n_lines", "qty", "price_cents", "n_returned"])})
select bv.feature, round(bv.v / (ov.v + 1e-9), 6) as separation_score
from bv join ov on ov.feature = bv.feature
""")
def q_segment_drivers(spark, d):
    return r6(segment.segment_drivers(_segment_features(spark, d),
                                      ["n_lines", "qty", "price_cents", "n_returned"]))


@query("segment_drift", f"""
with {SG},
g as (select safra, cluster, count(*) as rows, avg(p_churn) as p_churn_mean,
             avg(churn_3m::double) as churn_rate from sg group by safra, cluster)
select safra, cluster, rows, round(p_churn_mean, 6) as p_churn_mean,
       round(churn_rate, 6) as churn_rate,
       round(rows::double / sum(rows) over (partition by safra), 6) as share
from g
""")
def q_segment_drift(spark, d):
    return r6(segment.segment_drift(fx.segment_frame(spark, d)))


@query("segment_relabel", f"""
with {SG},
m as (select cluster, avg(p_churn) as m from sg group by cluster),
r as (select cluster, cast(row_number() over (order by m desc nulls last, cluster) - 1 as integer)
             as new_id from m)
select sg.msno, sg.safra, sg.p_churn, r.new_id as cluster
from sg left join r on sg.cluster = r.cluster
""")
def q_segment_relabel(spark, d):
    sg = fx.segment_frame(spark, d).select("msno", "safra", "p_churn", "cluster")
    return segment.relabel_by_risk(sg, "cluster", "p_churn")


@query("score_threshold", f"""
with {SF}
select round(quantile_cont(p_churn, 0.05), 6) as p05, round(quantile_cont(p_churn, 0.5), 6) as p50,
       round(quantile_cont(p_churn, 0.95), 6) as p95 from sf
""")
def q_score_threshold(spark, d):
    q = rank.exact_quantiles(fx.score_frame(spark, d), "p_churn", [0.05, 0.5, 0.95])
    return r6(spark.createDataFrame([(q[0.05], q[0.5], q[0.95])], "p05 double, p50 double, p95 double"))


@query("equal_width_histogram", f"""
with {MA},
v as (select bd from ma where bd between 10 and 90),
mm as (select min(bd) as mn, max(bd) as mx from v),
b as (select least(cast(floor((bd - mn) * 40 / (mx - mn)) as integer), 39) as bin, mn, mx from v, mm)
select bin, round(mn + bin * (mx - mn) / 40, 6) as bin_lo,
       round(mn + (bin + 1) * (mx - mn) / 40, 6) as bin_hi, count(*) as n
from b group by bin, mn, mx
""")
def q_equal_width_histogram(spark, d):
    return r6(binning.equal_width_histogram(fx.member_attrs(spark, d), "bd", 40, lo=10, hi=90))


@query("arpu", f"""
with {SP}, {SF}
select round(avg(price_cents / 100.0::double), 6) as ARPU_NTD, count(*) as n_paying
from sp where price_cents > 0 and safra in (select safra from sf)
""")
def q_arpu(spark, d):
    model = fx.supplier_panel(spark, d).withColumn("paid_sum", F.col("price_cents") / 100.0)
    return r6(scenario.arpu(model, fx.score_frame(spark, d).select("safra")))


@query("duplicate_keys", """
select l_orderkey, l_linenumber, count(*) as n_rows
from lineitem group by l_orderkey, l_linenumber having count(*) > 1
""")
def q_duplicate_keys(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return clean.duplicate_keys(li, ["l_orderkey", "l_linenumber"])


TOPK_SQL = SF + """,
n as (select count(*) as n from sf),
fr as (select unnest([0.01, 0.03, 0.05, 0.10, 0.20]::double[]) as top_frac),
kk as (select top_frac, cast(greatest(1, floor(n * top_frac)) as bigint) as k from fr, n),
rk as (select *, row_number() over (order by p_churn desc, msno, safra) as rn from sf),
tk as (select top_frac, k, cast(sum(case when rn <= k then churn_3m else 0 end) as bigint) as TP
       from kk, rk group by top_frac, k)"""


@query("topk_counts", f"""
with {TOPK_SQL}
select top_frac, k, TP, k - TP as FP from tk
""")
def q_topk_counts(spark, d):
    sf = metrics.reusable(fx.score_frame(spark, d), ["msno", "safra", "p_churn", "churn_3m"])
    rows = rank.topk_counts(sf, "p_churn", "churn_3m", metrics.CAMPAIGN_FRACS, ["msno", "safra"])
    return spark.createDataFrame([(r["top_frac"], r["k"], r["TP"], r["FP"]) for r in rows],
                                 "top_frac double, k bigint, TP bigint, FP bigint")


# =========================================================== 2.5 windows


@query("dedup_keep_last", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice
from lineitem
qualify row_number() over (partition by l_orderkey, l_linenumber
                           order by l_shipdate desc, l_partkey desc, l_suppkey desc,
                                    l_extendedprice desc) = 1
""")
def q_dedup_keep_last(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return clean.dedup(li, ["l_orderkey", "l_linenumber"],
                       ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"], keep="last",
                       cols=["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])


@query("dedup_keep_first", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice
from lineitem
qualify row_number() over (partition by l_orderkey, l_linenumber
                           order by l_shipdate, l_partkey, l_suppkey, l_extendedprice) = 1
""")
def q_dedup_keep_first(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return clean.dedup(li, ["l_orderkey", "l_linenumber"],
                       ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"], keep="first",
                       cols=["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])


@query("topk_flags", f"""
with {SF},
n as (select count(*) as n from sf),
rk as (select *, row_number() over (order by p_churn desc, msno, safra) as rn from sf)
select msno, safra, p_churn, churn_3m,
       cast(rn <= greatest(1, floor(n * 0.01::double)) as integer) as top_1,
       cast(rn <= greatest(1, floor(n * 0.03::double)) as integer) as top_3,
       cast(rn <= greatest(1, floor(n * 0.05::double)) as integer) as top_5,
       cast(rn <= greatest(1, floor(n * 0.10::double)) as integer) as top_10,
       cast(rn <= greatest(1, floor(n * 0.20::double)) as integer) as top_20
from rk, n
""")
def q_topk_flags(spark, d):
    sf = metrics.reusable(fx.score_frame(spark, d), ["msno", "safra", "p_churn", "churn_3m"])
    return rank.topk_flags(sf, "p_churn", metrics.CAMPAIGN_FRACS, ["msno", "safra"])


# =========================================================== 2.6 split / sets


@query("temporal_split", f"""
with {ELIG},
m as (select distinct safra from el),
r as (select safra, dense_rank() over (order by safra desc) as r from m)
select el.msno, el.safra,
       case when r <= 4 then 'test' when r <= 6 then 'val' else 'train' end as split
from el join r on r.safra = el.safra
""")
def q_temporal_split(spark, d):
    el = materialize(labels.eligible_trusted(_model(spark, d)).select("msno", "safra"), "eligible")
    from pulsepanel.operators.train import temporal_split
    return temporal_split(el)


@query("union_all", f"""
with {SP}, {ORDER_PANEL}
select 'supplier' as source, msno, safra, n_lines, null::double as paid_sum from sp
union all
select 'orders' as source, msno, safra, null::bigint as n_lines, round(paid_sum, 6) as paid_sum from op
""")
def q_union_all(spark, d):
    a = fx.supplier_panel(spark, d).select(F.lit("supplier").alias("source"), "msno", "safra",
                                           "n_lines")
    b = _order_panel(spark, d).select(F.lit("orders").alias("source"), "msno", "safra", "paid_sum")
    return r6(a.unionByName(b, allowMissingColumns=True))


@query("add_periods", f"""
with {SP}, m as (select distinct safra from sp)
select safra,
       cast((safra // 100) * 12 + safra % 100 - 1 as integer) as month_idx,
       cast(((safra // 100) * 12 + safra % 100 - 2) // 12 * 100
            + ((safra // 100) * 12 + safra % 100 - 2) % 12 + 1 as integer) as prev_period,
       cast(((safra // 100) * 12 + safra % 100 + 2) // 12 * 100
            + ((safra // 100) * 12 + safra % 100 + 2) % 12 + 1 as integer) as plus3_period
from m
""")
def q_add_periods(spark, d):
    m = tables.period_list(fx.supplier_panel(spark, d), "safra")
    return m.select("safra", P.period_index("safra").alias("month_idx"),
                    P.add_periods("safra", -1).alias("prev_period"),
                    P.add_periods("safra", 3).alias("plus3_period"))


# =========================================================== 2.10 metrics

AUC_SQL = SF + """,
h as (select p_churn, count(*) as n, sum(churn_3m) as pos from sf group by p_churn),
c as (select *, sum(n) over (order by p_churn desc rows between unbounded preceding and current row) as cum_n,
             sum(pos) over (order by p_churn desc rows between unbounded preceding and current row) as cum_pos
      from h),
t as (select sum(n) as n_all, sum(pos) as p_all from h)"""


@query("roc_auc", f"""
with {AUC_SQL}
select round((sum(pos * (n_all - cum_n + (n + 1) / 2.0)) - max(p_all) * (max(p_all) + 1) / 2.0)
             / (max(p_all) * (max(n_all) - max(p_all))), 6) as roc_auc
from c, t
""")
def q_roc_auc(spark, d):
    v = metrics.roc_auc(fx.score_frame(spark, d))
    return r6(spark.createDataFrame([(v,)], "roc_auc double"))


@query("average_precision", f"""
with {AUC_SQL}
select round(sum(pos * (cum_pos::double / cum_n)) / max(p_all), 6) as pr_auc from c, t
""")
def q_average_precision(spark, d):
    v = metrics.average_precision(fx.score_frame(spark, d))
    return r6(spark.createDataFrame([(v,)], "pr_auc double"))


@query("campaign_curve", f"""
with {TOPK_SQL},
b as (select avg(churn_3m::double) as base, sum(churn_3m) as pos from sf)
select top_frac, k, TP, k - TP as FP,
       round(case when pos > 0 then TP::double / pos else 0.0 end, 6) as recall,
       round(TP::double / k, 6) as churn_rate, round(base, 6) as base_churn,
       round(case when base > 0 then (TP::double / k) / base end, 6) as lift
from tk, b
""")
def q_campaign_curve(spark, d):
    rows = metrics.campaign_curve_rows(fx.score_frame(spark, d))
    schema = ("top_frac double, k bigint, TP bigint, FP bigint, recall double, churn_rate double, "
              "base_churn double, lift double")
    return r6(spark.createDataFrame(
        [(r["top_frac"], r["k"], r["TP"], r["FP"], r["recall"], r["churn_rate"], r["base_churn"],
          r["lift"]) for r in rows], schema))


def _score_splits(spark, d):
    from pulsepanel.operators.train import temporal_split
    return temporal_split(fx.score_frame(spark, d))


@query("model_metrics", f"""
with {SF},
m as (select distinct safra from sf),
r as (select safra, dense_rank() over (order by safra desc) as r from m),
s as (select sf.*, case when r <= 4 then 'test' when r <= 6 then 'val' else 'train' end as split
      from sf join r on r.safra = sf.safra),
h as (select split, p_churn, count(*) as n, sum(churn_3m) as pos from s group by split, p_churn),
c as (select *, sum(n) over (partition by split order by p_churn desc
                             rows between unbounded preceding and current row) as cum_n,
             sum(pos) over (partition by split order by p_churn desc
                            rows between unbounded preceding and current row) as cum_pos from h),
t as (select split, sum(n) as n_all, sum(pos) as p_all from h group by split),
a as (select c.split,
             (sum(pos * (n_all - cum_n + (n + 1) / 2.0)) - max(p_all) * (max(p_all) + 1) / 2.0)
               / (max(p_all) * (max(n_all) - max(p_all))) as roc_auc,
             sum(pos * (cum_pos::double / cum_n)) / max(p_all) as pr_auc
      from c join t on t.split = c.split group by c.split),
rk as (select s.*, row_number() over (partition by split order by p_churn desc, msno, safra) as rn
       from s),
k as (select split, greatest(1, floor(count(*) * 0.05::double)) as k5,
             greatest(1, floor(count(*) * 0.10::double)) as k10, sum(churn_3m) as pos
      from s group by split),
tk as (select rk.split, max(k.k5) as k5, max(k.pos) as pos,
              sum(case when rn <= k.k5 then churn_3m else 0 end) as tp5,
              sum(case when rn <= k.k10 then churn_3m else 0 end) as tp10
       from rk join k on k.split = rk.split group by rk.split)
select a.split as "set", round(roc_auc, 6) as roc_auc, round(pr_auc, 6) as pr_auc,
       round(case when pos > 0 then tp5::double / pos else 0.0 end, 6) as recall_top5pct,
       round(tp5::double / k5, 6) as churnrate_top5pct,
       round(case when pos > 0 then tp10::double / pos else 0.0 end, 6) as recall_top10pct,
       cast(k5 as bigint) as k5
from a join tk on tk.split = a.split where a.split in ('val', 'test')
""")
def q_model_metrics(spark, d):
    s = metrics.reusable(_score_splits(spark, d), ["msno", "safra", "p_churn", "churn_3m", "split"])
    rows = metrics.eval_sets(s, "split", ("val", "test"))
    schema = ("set string, roc_auc double, pr_auc double, recall_top5pct double, "
              "churnrate_top5pct double, recall_top10pct double, k5 bigint")
    return r6(spark.createDataFrame(
        [(r["set"], r["roc_auc"], r["pr_auc"], r["recall_top5pct"], r["churnrate_top5pct"],
          r["recall_top10pct"], r["k5"]) for r in rows], schema))


# =========================================================== 2.11 business

GRID_SQL = TOPK_SQL + ",\n" + SP + """,
ar as (select avg(price_cents / 100.0::double) as arpu from sp
       where price_cents > 0 and safra in (select safra from sf)),
b as (select avg(churn_3m::double) as base from sf),
g as (select fm.free_months, ac.accept_rate, tk.top_frac, tk.k, tk.TP, tk.k - tk.TP as FP,
             case when tk.k > 0 then tk.TP::double / tk.k else 0.0 end as precision_at_k,
             b.base as base_churn_rate_test, ar.arpu as ARPU_NTD
      from tk, ar, b,
           (select unnest([1, 2, 3]) as free_months) fm,
           (select unnest([0.3, 0.5, 0.7]::double[]) as accept_rate) ac),
gg as (select *, case when base_churn_rate_test > 0 then precision_at_k / base_churn_rate_test end as lift,
              accept_rate * TP * greatest(0, 12 - free_months) * ARPU_NTD as expected_gain_NTD,
              FP * free_months * ARPU_NTD as expected_cost_NTD from g),
grid as (select *, expected_gain_NTD - expected_cost_NTD as expected_net_NTD from gg)"""

GRID_COLS = """free_months, round(accept_rate, 6) as accept_rate, round(top_frac, 6) as top_frac, k, TP, FP,
       round(precision_at_k, 6) as precision_at_k, round(base_churn_rate_test, 6) as base_churn_rate_test,
       round(lift, 6) as lift, round(ARPU_NTD, 6) as ARPU_NTD, round(expected_gain_NTD, 2) as expected_gain_NTD,
       round(expected_cost_NTD, 2) as expected_cost_NTD, round(expected_net_NTD, 2) as expected_net_NTD"""


def _money(df: DataFrame) -> DataFrame:
    """Currency outputs to cents (their products carry ~1e-7 summation noise)."""
    for c in ("expected_gain_NTD", "expected_cost_NTD", "expected_net_NTD"):
        df = df.withColumn(c, F.round(c, 2))
    return df


def _grid(spark, d):
    sf = metrics.reusable(fx.score_frame(spark, d), ["msno", "safra", "p_churn", "churn_3m"])
    curve = metrics.campaign_curve_rows(sf, reuse=False)
    model = fx.supplier_panel(spark, d).withColumn("paid_sum", F.col("price_cents") / 100.0)
    a = scenario.arpu(model, sf.select("safra")).first()["ARPU_NTD"]
    cdf = spark.createDataFrame([(r["top_frac"], r["k"], r["TP"], r["FP"]) for r in curve],
                                "top_frac double, k bigint, TP bigint, FP bigint")
    return scenario.scenario_grid(cdf, a, curve[0]["base_churn"])


@query("scenario_grid", f"""
with {GRID_SQL}
select {GRID_COLS} from grid
""")
def q_scenario_grid(spark, d):
    return _money(r6(_grid(spark, d)))


@query("best_policy", f"""
with {GRID_SQL}
select {GRID_COLS} from grid
qualify row_number() over (partition by free_months, accept_rate
                           order by round(expected_net_NTD, 2) desc, top_frac) = 1
""")
def q_best_policy(spark, d):
    return _money(r6(scenario.best_policy(_grid(spark, d))))


# =========================================================== 2.12 audit


@query("audit_label_trust", f"""
with {DIAG}
select count(*) as n_months, min(safra) as period_min, max(safra) as period_max,
       coalesce(string_agg(case when label_trust = 0 then cast(safra as varchar) end, ','
                           order by safra), '') as suspect_periods
from diag
""")
def q_audit_label_trust(spark, d):
    return profile.audit_label_trust(_diag(spark, d))


@query("table_profile", f"""
with {MODEL}
select count(*) as rows, 21 as cols,
       'safra,msno,month_idx,n_lines,qty,price_cents,n_returned,is_ativo,n_lines_lag1,qty_lag1,price_cents_lag1,n_returned_lag1,n_lines_diff1,qty_diff1,price_cents_diff1,n_returned_diff1,is_ativo_fut,churn_3m,fut_active_rate,churn_rate_month,label_trust' as columns,
       min(safra) as period_min, max(safra) as period_max
from mt
""")
def q_table_profile(spark, d):
    return profile.table_profile(_model(spark, d))


# =========================================================== 2.9 / 2.10 prep


# Sample order: first 15 hex digits of md5('seed|keys'), then the keys.
@query("stratified_sample", f"""
with {SF},
h as (select *, substr(md5(concat_ws('|', '42', msno::varchar, safra::varchar)), 1, 15) as h
      from sf),
c as (select safra, count(*) as rows from h group by safra),
t as (select count(*) as n from h),
z as (select safra, least(rows, greatest(1, round_even(rows * (2000.0::double / n), 0))) as n_sample
      from c, t),
p as (select h.* from h join z using (safra)
      qualify row_number() over (partition by safra order by h, msno) <= max(n_sample)
              over (partition by safra))
select msno, safra, month_idx, churn_3m, p_churn from p
qualify row_number() over (order by h, msno, safra) <= 2000
""")
def q_stratified_sample(spark, d):
    return sample.stratified_sample(fx.score_frame(spark, d), 2000, "safra", ["msno"])


@query("stratified_sizes", f"""
with {SF},
c as (select safra, count(*) as rows from sf group by safra),
t as (select count(*) as n from sf)
select safra, cast(least(rows, greatest(1, round_even(rows * (2000.0::double / n), 0))) as bigint) as n
from c, t
""")
def q_stratified_sizes(spark, d):
    s = sample.stratified_sample(fx.score_frame(spark, d), 2000, "safra", ["msno"])
    return s.groupBy("safra").agg(F.count(F.lit(1)).alias("n"))


@query("stratified_sample_null_period", f"""
with {SF},
s0 as (select msno, case when msno % 9 = 0 then null else safra end as safra, p_churn, month_idx from sf),
h as (select *, substr(md5(concat_ws('|', '42', msno::varchar, month_idx::varchar, safra::varchar)), 1, 15) as h
      from s0),
c as (select safra, count(*) as rows from h group by safra),
t as (select count(*) as n from h),
z as (select safra, least(rows, greatest(1, round_even(rows * (500.0::double / n), 0))) as n_sample
      from c, t),
r as (select h.*, z.n_sample, row_number() over (partition by h.safra order by h.h, msno, month_idx) as rk
      from h join z on h.safra is not distinct from z.safra),
p as (select *, row_number() over (order by h, msno, month_idx, safra nulls first) as g
      from r where rk <= n_sample)
select msno, safra, month_idx, round(p_churn, 6) as p_churn from p where g <= 500
""")
def q_stratified_sample_null_period(spark, d):
    x = fx.score_frame(spark, d).select(
        "msno", F.when(F.col("msno").cast("long") % 9 != 0, F.col("safra")).alias("safra"), "p_churn",
        "month_idx")
    return r6(sample.stratified_sample(x, 500, "safra", ["msno", "month_idx"]))


@query("uniform_sample", f"""
with {SF}
select msno, safra, month_idx, churn_3m, p_churn from sf
qualify row_number() over (
  order by substr(md5(concat_ws('|', '42', msno::varchar, safra::varchar)), 1, 15), msno, safra)
  <= 1000
""")
def q_uniform_sample(spark, d):
    # exact-size seeded sample of the score frame (X2)
    return sample.uniform_sample(fx.score_frame(spark, d), 1000, ["msno", "safra"])


@query("median_impute", f"""
with {FEAT},
m as (select median(returned_cents::double) as m1, median(ret_lines::double) as m2,
             median(max_tax) as m3 from ft where safra < 199901)
select msno, safra, round(coalesce(returned_cents::double, m1), 6) as returned_cents,
       round(coalesce(ret_lines::double, m2), 6) as ret_lines, round(coalesce(max_tax, m3), 6) as max_tax
from ft, m
""")
def q_median_impute(spark, d):
    ft = _features(spark, d)
    cols = ["returned_cents", "ret_lines", "max_tax"]
    x = ft.select("msno", "safra", *[F.col(c).cast("double").alias(c) for c in cols])
    return r6(prep.median_impute(x.where(F.col("safra") < 199901), cols, apply_to=x))


@query("mode_impute", f"""
with {MR},
c as (select gender, count(*) as n from mr where gender is not null group by gender),
m as (select gender as g from c order by n desc, gender limit 1)
select msno, _ord, coalesce(gender, g) as gender from mr, m
""")
def q_mode_impute(spark, d):
    mr = fx.member_rows(spark, d).select("msno", "_ord", "gender")
    return prep.mode_impute(mr, ["gender"])


@query("standardize", f"""
with {SP},
s as (select avg(n_lines::double) as m1, stddev_pop(n_lines::double) as s1,
             avg(qty) as m2, stddev_pop(qty) as s2,
             avg(price_cents::double) as m3, stddev_pop(price_cents::double) as s3 from sp)
select msno, safra, round((n_lines - m1) / case when s1 = 0 then 1 else s1 end, 6) as n_lines,
       round((qty - m2) / case when s2 = 0 then 1 else s2 end, 6) as qty,
       round((price_cents - m3) / case when s3 = 0 then 1 else s3 end, 6) as price_cents
from sp, s
""")
def q_standardize(spark, d):
    sp = fx.supplier_panel(spark, d).select("msno", "safra", "n_lines", "qty", "price_cents")
    return r6(prep.standardize(sp, ["n_lines", "qty", "price_cents"]))


# =========================================================== ML (rows-only)




def _doc_model(spark, d):
    from pulsepanel.operators.train import fit_churn_model

    docs = fx.doc_frame(spark, d).withColumn(
        "split", F.when(F.col("quality").isNull(), "unlabelled")
        .when(F.xxhash64(F.lit(7), "doc_id") % 5 == 0, "test").otherwise("train"))
    docs = materialize(docs, "documents")  # every step of a fit reads it: words are counted once
    train = docs.where(F.col("split") == "train")
    # the reference's settings: depth 6, rate 0.08, 300 rounds, 255 bins, seed 42
    model = fit_churn_model(train, label="quality", extra_drop=["doc_id", "toxic"],
                            categorical=["lang", "source"])
    return docs, model


@query("churn_gbt")
def q_churn_gbt(spark, d):
    """Batch scoring of every document; labelled ones outside test train it."""
    docs, model = _doc_model(spark, d)
    return model.score(docs).select("doc_id", "split", "quality", "p_churn")


@query("permutation_importance")
def q_permutation_importance(spark, d):
    from pulsepanel.operators.train import permutation_importance

    docs, model = _doc_model(spark, d)
    train = docs.where(F.col("split") == "train")
    return permutation_importance(model, train, "quality", ["doc_id"], n_repeats=5)


@query("choose_k")
def q_choose_k(spark, d):
    from pyspark.ml.functions import array_to_vector

    v = fx.vector_frame(spark, d).withColumn("features", array_to_vector("embedding"))
    best, rows_ = segment.choose_k(v, range(2, 11))
    return spark.createDataFrame([(r["k"], r["inertia"], r["silhouette"], int(r["k"] == best))
                                  for r in rows_],
                                 "k int, inertia double, silhouette double, chosen int")


@query("segment_kmeans")
def q_segment_kmeans(spark, d):
    from pyspark.ml.functions import array_to_vector

    v = fx.vector_frame(spark, d).withColumn("features", array_to_vector("embedding"))
    m = segment.kmeans_fit(v, 10)
    return m.transform(v).select("vec_id", "label", "cluster")


# Squared-Euclidean silhouette of the labelled clusters.  The mean distance
# of x to cluster C is |x|^2 + sum_C |y|^2 / n_C - 2 x . sum_C y / n_C; the
# own-cluster mean excludes x itself (x n / (n - 1)); a singleton scores 0.
@query("silhouette_sq", """
with e as (select vec_id, label as c, cast(embedding as double[]) as x
           from embeddings where label is not null),
u as (select vec_id, c, unnest(x) as v, unnest(generate_series(1, len(x))) as d from e),
cs as (select c, d, sum(v) as s from u group by c, d),
cn as (select c, count(*)::double as n, sum(list_dot_product(x, x)) as q from e group by c),
dt as (select u.vec_id, cs.c as t, sum(u.v * cs.s) as xs
       from u join cs on u.d = cs.d group by u.vec_id, cs.c),
dist as (select e.vec_id, e.c, dt.t, cn.n as nt,
                list_dot_product(e.x, e.x) + cn.q / cn.n - 2 * dt.xs / cn.n as dd
         from e join dt on e.vec_id = dt.vec_id join cn on cn.c = dt.t),
own as (select vec_id, nt, dd * nt / (nt - 1) as a from dist where t = c),
oth as (select vec_id, min(dd) as b from dist where t <> c group by vec_id),
pt as (select case when own.nt = 1 then 0.0 when a < b then 1 - a / b
                   when a > b then b / a - 1 else 0.0 end as si
       from own join oth using (vec_id))
select round(avg(si), 6) as silhouette from pt
""")
def q_silhouette_sq(spark, d):
    from pyspark.ml.functions import array_to_vector

    v = fx.vector_frame(spark, d).where(F.col("label").isNotNull())
    v = v.withColumn("features", array_to_vector("embedding"))
    s = segment.silhouette_sq(v.withColumn("cluster", F.col("label").cast("int")))
    return r6(spark.createDataFrame([(s,)], "silhouette double"))


@query("silhouettes_of_clusterings", """
with e0 as (select vec_id, label, cast(embedding as double[]) as x
            from embeddings where label is not null),
e as (select m, vec_id, label % m as c, x from e0, (select unnest([2, 3, 5]) as m) ms),
u as (select m, vec_id, c, unnest(x) as v, unnest(generate_series(1, len(x))) as d from e),
cs as (select m, c, d, sum(v) as s from u group by m, c, d),
cn as (select m, c, count(*)::double as n, sum(list_dot_product(x, x)) as q from e group by m, c),
dt as (select u.m, u.vec_id, cs.c as t, sum(u.v * cs.s) as xs
       from u join cs on u.d = cs.d and u.m = cs.m group by u.m, u.vec_id, cs.c),
dist as (select e.m, e.vec_id, e.c, dt.t, cn.n as nt,
                list_dot_product(e.x, e.x) + cn.q / cn.n - 2 * dt.xs / cn.n as dd
         from e join dt on e.vec_id = dt.vec_id and e.m = dt.m join cn on cn.c = dt.t and cn.m = e.m),
own as (select m, vec_id, nt, dd * nt / (nt - 1) as a from dist where t = c),
oth as (select m, vec_id, min(dd) as b from dist where t <> c group by m, vec_id),
pt as (select m, case when own.nt = 1 then 0.0 when a < b then 1 - a / b
                      when a > b then b / a - 1 else 0.0 end as si
       from own join oth using (m, vec_id))
select m as clusters, round(avg(si), 6) as silhouette from pt group by m
""")
def q_silhouettes_of_clusterings(spark, d):
    """Silhouettes of three clusterings of all vectors, from two passes."""
    from pyspark.ml.functions import array_to_vector

    v = fx.vector_frame(spark, d).where(F.col("label").isNotNull())
    v = v.withColumn("features", array_to_vector("embedding"))
    ms = (2, 3, 5)
    found = segment.silhouettes_sq(v.select("features", *[(F.col("label") % m).alias(f"c{m}") for m in ms]),
                                   [f"c{m}" for m in ms])
    return r6(spark.createDataFrame([(m, found[f"c{m}"]) for m in ms], "clusters int, silhouette double"))


@query("reference_churn_model")
def q_reference_churn_model(spark, d):
    """Modelling chain: model table -> metrics per evaluation set.

    Eligible trusted rows, last 4 periods test and the 2 before validation,
    imputation + one-hot + GBT with the reference's settings fitted on
    train, then ROC-AUC, average precision and top-5 % / 10 % campaign
    numbers of validation and test from one grouped pass.
    """
    from pulsepanel.operators.train import fit_churn_model, temporal_split

    mt = temporal_split(labels.eligible_trusted(_model(spark, d)))
    mt = metrics.reusable(mt, mt.columns)
    model = fit_churn_model(mt.where(F.col("split") == "train"), "churn_3m",
                            extra_drop=["month_idx", "split"])
    scored = model.score(mt.where(F.col("split").isin("val", "test")))
    rows = metrics.eval_sets(scored, "split", ("val", "test"))
    schema = ("set string, roc_auc double, pr_auc double, recall_top5pct double, "
              "churnrate_top5pct double, recall_top10pct double, k5 bigint")
    return r6(spark.createDataFrame(
        [(r["set"], r["roc_auc"], r["pr_auc"], r["recall_top5pct"], r["churnrate_top5pct"],
          r["recall_top10pct"], r["k5"]) for r in rows], schema))


# ----------------------------------------------- search over settings (M9)
def _split_model(spark, d):
    """Eligible trusted rows with their split, written once."""
    from pulsepanel.operators.train import temporal_split

    mt = temporal_split(labels.eligible_trusted(_model(spark, d)))
    return metrics.reusable(mt, mt.columns)


def _search(spark, d):
    """The reference's three settings on the model table; out-of-time validation
    rows end the boosting."""
    from pulsepanel.operators.search import model_search

    return model_search(_split_model(spark, d), extra_drop=["month_idx"], early_tol=EARLY_TOL)


#: A fit ends when a round lowers the validation error by less than this share.
EARLY_TOL = 0.001


@query("model_search")
def q_model_search(spark, d):
    """One row per setting: rounds, validation metrics and the choice."""
    return r6(_search(spark, d).report)


SPLIT = ELIG + """,
sm as (select distinct safra from el),
sr as (select safra, dense_rank() over (order by safra desc) as r from sm),
sl as (select el.*, case when r <= 4 then 'test' when r <= 6 then 'val' else 'train' end as split
       from el join sr on sr.safra = el.safra)"""


@query("model_search_scores", f"""
with {SPLIT}
select msno, safra, split, churn_3m, true as scored from sl where split in ('val', 'test')
""")
def q_model_search_scores(spark, d):
    """The written score table: every validation and test row, with a score."""
    scores = _search(spark, d).scores
    return scores.select("msno", "safra", "split", "churn_3m", F.col("p_churn").between(0, 1).alias("scored"))


@query("model_features", f"""
with {MODEL}
select column_name as feature from (describe select * from mt)
where column_name not in ('msno', 'safra', 'safra_fut', 'is_ativo_fut', 'churn_3m', 'fut_active_rate',
                          'churn_rate_month', 'is_ativo', 'label_trust', 'month_idx')
""")
def q_model_features(spark, d):
    """Columns of the model table that a model may see."""
    from pulsepanel.operators.train import feature_columns

    numeric, _ = feature_columns(_model(spark, d), extra_drop=["month_idx"])
    return spark.createDataFrame([(c,) for c in numeric], "feature string")


@query("model_summary", f"""
with {SPLIT}
select split, count(*) as rows, sum(churn_3m)::bigint as churners, count(distinct safra) as periods,
       cast(min(safra) as bigint) as first_period, cast(max(safra) as bigint) as last_period
from sl group by split
""")
def q_model_summary(spark, d):
    """Summary of the training data, written as JSON beside the published model
    and read back from there."""
    from pulsepanel.operators.train import ChurnModel, fit_churn_model
    from pulsepanel.sources.snapshots import publish_folder, published_folder

    mt = _split_model(spark, d)
    model = fit_churn_model(mt.where(F.col("split") == "train"), params={"max_depth": 3, "max_iter": 5},
                            extra_drop=["month_idx", "split"])
    path = _scratch(spark, "model")
    model.save(f"{path}/model")
    summary = mt.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("churn_3m").alias("churners"),
        F.countDistinct("safra").alias("periods"), F.min("safra").cast("long").alias("first_period"),
        F.max("safra").cast("long").alias("last_period"))
    publish_folder(spark, f"{path}/summary", lambda at: write_json_summary(summary, at, single_file=True))
    assert ChurnModel.load(f"{path}/model").numeric == model.numeric
    return spark.read.schema(summary.schema).json(published_folder(spark, f"{path}/summary"))


# ------------------------------------------------------------- sinks (2.1)
def _scratch(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/sinks/{name}-{uuid.uuid4().hex}"


@query("sink_roundtrip", f"""
with {SP}
select safra, count(*) as n, sum(n_lines)::bigint as n_lines, round(sum(qty), 6) as qty from sp group by safra
""")
def q_sink_roundtrip(spark, d):
    """The panel written twice by period and read back: a rerun adds nothing."""
    sp = fx.supplier_panel(spark, d).select("msno", "safra", "n_lines", "qty")
    path = _scratch(spark, "roundtrip")
    for _ in range(2):
        write_parquet(sp, path, partition_by="safra")
    return r6(spark.read.parquet(path).groupBy("safra").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_lines").alias("n_lines"), F.sum("qty").alias("qty")))


@query("sink_dynamic_month", f"""
with {SP},
m as (select max(safra) as top from sp)
select safra, count(*) as n, sum(case when safra = top then n_lines + 1 else n_lines end)::bigint as n_lines
from sp, m group by safra
""")
def q_sink_dynamic_month(spark, d):
    """The last period rewritten in place; the others stay."""
    sp = fx.supplier_panel(spark, d).select("msno", "safra", "n_lines")
    path = _scratch(spark, "dynamic")
    write_parquet(sp, path, partition_by="safra")
    top = spark.read.parquet(path).agg(F.max("safra")).first()[0]
    new = sp.where(F.col("safra") == top).withColumn("n_lines", F.col("n_lines") + 1)
    write_parquet(new, path, partition_by="safra", dynamic=True)
    return spark.read.parquet(path).groupBy("safra").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_lines").alias("n_lines"))


@query("partition_read", f"""
with {SP}
select msno, safra, n_lines from sp where safra between 199506 and 199508
""")
def q_partition_read(spark, d):
    """Three periods of a table written by period: other folders are not read."""
    path = _scratch(spark, "pruned")
    write_parquet(fx.supplier_panel(spark, d).select("msno", "safra", "n_lines"), path,
                  partition_by="safra")
    return tables.scan_month_filter(spark.read.parquet(path), "safra", [199506, 199507, 199508],
                                    ["msno", "safra", "n_lines"])


@query("mixed_schema_scan", """
select l_orderkey, l_linenumber, l_quantity::double as l_quantity,
       case when l_linenumber % 3 <> 1 then l_tax end as l_tax,
       case when l_linenumber % 3 = 2 then l_returnflag end as l_note
from lineitem
""")
def q_mixed_schema_scan(spark, d):
    """lineitem stored as files of three schemas - a column short, a number as
    an integer, a number as text - and read as one table."""
    li = fx.table(spark, d, "lineitem")
    path, kind = _scratch(spark, "mixed"), F.col("l_linenumber") % 3
    base = li.select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_returnflag")
    for i, part in enumerate((
            base.drop("l_returnflag"),
            base.select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("l_quantity")),
            base.withColumn("l_quantity", F.col("l_quantity").cast("string"))
                .withColumnRenamed("l_returnflag", "l_note"))):
        write_parquet(part.where(kind == i), f"{path}/kind={i}")
    return mixed.read_mixed(spark, path, numeric=["l_quantity"],
                            columns=["l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_note"])


@query("snapshot_roundtrip", f"""
with {SP},
m as (select max(safra) as top from sp)
select safra, count(*) as n, sum(case when safra = top then n_lines + 1 else n_lines end)::bigint as n_lines
from sp, m group by safra
""")
def q_snapshot_roundtrip(spark, d):
    """The panel published by period, then its last period as a new version."""
    from pulsepanel.sources.snapshots import current, publish, read_snapshot, replace_periods

    path = _scratch(spark, "snapshot")
    publish(fx.supplier_panel(spark, d).select("msno", "safra", "n_lines"), path, "safra")
    top = max(int(p) for p in current(spark, path).parts)
    last = read_snapshot(spark, path, periods=[top])
    replace_periods(last.withColumn("n_lines", F.col("n_lines") + 1), path, [top])
    return read_snapshot(spark, path).groupBy("safra").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_lines").alias("n_lines"))


@query("report_roundtrip", f"""
with {SP}
select safra, count(*) as n, round(avg(qty), 6) as qty from sp group by safra
""")
def q_report_roundtrip(spark, d):
    """A per-period report written as CSV and read with its schema."""
    report = r6(fx.supplier_panel(spark, d).groupBy("safra").agg(
        F.count(F.lit(1)).alias("n"), F.avg("qty").alias("qty")))
    path = _scratch(spark, "report")
    write_report_csv(report, path, single_file=True)
    return read_report_csv(spark, path, "safra int, n bigint, qty double")


def _segments(spark, d):
    """Segmentation chain: model table ⋈ test scores -> rows with their segment.

    Dedup both sides (keep last), keep model periods that have scores,
    validated one-to-one join, p95 action flags, median imputation +
    population scaling, k chosen on all rows, k-means with restarts, ids
    relabelled by risk.  Returns (rows with ``features``, feature names).
    """
    from pulsepanel.operators import prep

    keys = ["msno", "safra"]
    model = _model(spark, d).drop("churn_3m")
    scores = fx.score_frame(spark, d).select("msno", "safra", "p_churn", "churn_3m")
    model = clean.dedup(model, keys, ["month_idx"], keep="last")
    scores = clean.dedup(scores, keys, ["p_churn"], keep="last")
    model = joins.semi_join_periods(model, scores, "safra")
    x = materialize(joins.join_one_to_one(model, scores, keys), "segment_rows")
    require_rows(x, "model table joined to the scores")
    thr = rank.exact_quantiles(x, "p_churn", [0.95])[0.95]
    x = segment.confusion_flags(x, thr)
    feats = segment.cluster_features(x.schema, segment.CLUSTER_PREFERRED)
    x = prep.median_impute(x, feats)
    x = prep.standardize(x, feats, suffix="__z")
    v = materialize(segment.assemble(x, [f"{c}__z" for c in feats]), "segment_vectors")
    best, _ = segment.choose_k(v, range(2, 11))
    pred = segment.kmeans_fit(v, best, restarts=segment.FINAL_RESTARTS).transform(v)
    return materialize(segment.relabel_by_risk(pred, "cluster", "p_churn"), "segments"), feats


@query("reference_segments")
def q_reference_segments(spark, d):
    """Profile of the segments of the chain, by descending mean score."""
    pred, _ = _segments(spark, d)
    return r6(segment.segment_profile(pred.drop("features"), extra_means=["n_lines", "qty"]))


@query("reference_segment_reports")
def q_reference_segment_reports(spark, d):
    """Separation drivers, monthly drift and silhouette of the same segments,
    as rows (report, key, value)."""
    pred, feats = _segments(spark, d)
    drivers = segment.segment_drivers(pred, feats).select(
        F.lit("drivers").alias("report"), F.col("feature").alias("key"),
        F.col("separation_score").alias("value"))
    drift = segment.segment_drift(pred).select(
        F.lit("drift"), F.concat_ws("|", "safra", "cluster"), F.col("share"))
    whole = spark.createDataFrame([("silhouette", "all", segment.silhouette_sq(pred))],
                                  "report string, key string, value double")
    return r6(drivers.unionAll(drift).unionAll(whole))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)


# =========================================================== full chain
# Raw usage logs, transactions and membership rows -> monthly features ->
# lag/diff of the eight base columns -> forward label -> month verdict: the
# reference's 32-column model table, in its column names.

BASE8 = ["total_secs", "num_unq", "paid_sum", "plays_total", "has_usage", "has_payment",
         "auto_renew_rate", "cancel_txn_count"]


def reference_features(spark, d):
    ul = panel.usage_monthly(fx.line_logs(spark, d))
    tx = panel.payments_monthly(fx.order_txn(spark, d))
    mb = panel.members_monthly(fx.member_rows(spark, d))
    return panel.feature_join(ul, [tx, mb])


def _lagcols_sql(cols):
    out = []
    for c in cols:
        out.append(f"cast(p.{c} as double) as {c}_lag1")
    for c in cols:
        out.append(f"a.{c} - cast(p.{c} as double) as {c}_diff1")
    return ",\n         ".join(out)


REF_CHAIN = f"ll as ({fx.SQL_LINE_LOGS}), " + ORDER_PANEL + ",\n" + MR + """,
ug as (select msno, safra, sum(num_unq) as num_unq, sum(total_secs) as total_secs,
              sum(num_25 + num_50 + num_75 + num_985 + num_100) as plays_total
       from ll group by msno, safra),
mm as (select msno, safra, max(is_ativo) as is_ativo from mr group by msno, safra),
ft as (select ug.msno, ug.safra, ug.total_secs, ug.num_unq, op.paid_sum, ug.plays_total,
              cast(coalesce(ug.total_secs, 0) > 0 as integer) as has_usage,
              cast(coalesce(op.paid_sum, 0) > 0 as integer) as has_payment,
              op.auto_renew_rate, op.cancel_txn_count, mm.is_ativo,
              cast((ug.safra // 100) * 12 + ug.safra % 100 - 1 as integer) as month_idx
       from ug left join op on op.msno = ug.msno and op.safra = ug.safra
               left join mm on mm.msno = ug.msno and mm.safra = ug.safra),
cx as (
  select a.msno, a.safra, a.month_idx, """ + ", ".join(f"a.{c}" for c in BASE8) + """,
         cast(coalesce(a.is_ativo, 0) as integer) as is_ativo,
         """ + _lagcols_sql(BASE8) + """,
         case when f.msno is null then null
              else cast(coalesce(f.is_ativo, 0) as integer) end as is_ativo_fut
  from ft a
  left join ft p on p.msno = a.msno and p.month_idx = a.month_idx - 1
  left join ft f on f.msno = a.msno and f.month_idx = a.month_idx + 3
)""" + DIAG[DIAG.index(",\ndg as ("):] + MODEL[MODEL.index(",\nmt as ("):]

_REF_OUT = (["msno", "safra", *BASE8, "is_ativo", *[f"{c}_lag1" for c in BASE8],
             *[f"{c}_diff1" for c in BASE8], "is_ativo_fut", "churn_3m", "label_trust",
             "fut_active_rate", "churn_rate_month"])


def _sql_round(c):
    ints = {"msno", "safra", "has_usage", "has_payment", "is_ativo", "is_ativo_fut", "churn_3m",
            "label_trust"}
    return c if c in ints else f"round({c}, 6) as {c}"


@query("reference_model_table", f"""
with {REF_CHAIN}
select {", ".join(_sql_round(c) for c in _REF_OUT)} from mt
""")
def q_reference_model_table(spark, d):
    feat = reference_features(spark, d).select("msno", "safra", *BASE8, "is_ativo")
    return r6(labels.model_table(feat, BASE8))


@query("reference_label_trust", f"""
with {REF_CHAIN}
select safra, rows, round(fut_active_rate, 6) as fut_active_rate, round(churn_rate, 6) as churn_rate,
       label_trust from diag
""")
def q_reference_label_trust(spark, d):
    feat = reference_features(spark, d).select("msno", "safra", "is_ativo")
    return r6(labels.label_trust(labels.forward_status(feat)))


@query("bucketed_model_table", ORACLES["reference_model_table"])
def q_bucketed_model_table(spark, d):
    """The model table from monthly tables stored by customer: the join, the
    lags and the forward status cross no exchange on the customer."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    monthly = (panel.usage_monthly(fx.line_logs(spark, d)), panel.payments_monthly(fx.order_txn(spark, d)),
               panel.members_monthly(fx.member_rows(spark, d)))
    names = [f"monthly_{uuid.uuid4().hex}" for _ in monthly]
    stored = [write_bucketed(df, name, "msno", ["safra"], buckets, _scratch(spark, name))
              for df, name in zip(monthly, names)]
    with by_bucket(spark):
        feat = panel.feature_join(stored[0], stored[1:]).select("msno", "safra", *BASE8, "is_ativo")
        out = materialize(r6(labels.model_table(feat, BASE8)), "bucketed_model")
    for name in names:  # the files stay with the scratch tables
        spark.sql(f"drop table {name}")
    return out
