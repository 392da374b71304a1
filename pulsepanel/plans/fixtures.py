"""Panels derived from the test tables, in the reference's vocabulary.

Each fixture is a Spark DataFrame plus the equivalent DuckDB SQL text, so a
query and its oracle start from the same rows.  Roles (see FIXTURES.md):

* ``supplier_panel``  lineitem by (supplier, ship month) - dense customer-month
  panel; ``is_ativo`` = any line with return flag 'N' that month.
* ``returns_panel``   returned lines by (supplier, month) - a payment side
  whose LEFT join leaves NULLs.
* ``censored_panel``  supplier_panel without 199806 and with status forced to
  0 outside 199601..200106 - exercises every label-trust branch.
* ``order_txn``       orders as transaction rows (amount, list price with
  NULLs, plan days, auto-renew, cancel).
* ``usage_logs``      events as usage rows with a daily period.
* ``member_rows``     orders ⋈ customer as membership rows (attributes with
  NULLs and out-of-range ages, status).
* ``member_attrs``    one row per customer (city, age, gender).
* ``score_frame``     eligible observed supplier-months with a deterministic
  tie-heavy score ``p_churn``.
* ``segment_frame``   score_frame + ``cluster`` = key mod 4.
* ``vector_frame``    embeddings.
* ``doc_frame``       documents ⋈ labels.

Money is whole units or BIGINT cents so sums are exact on both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsepanel.functions.periods import (
    day_index, index_of_timestamp, period_of_timestamp,
)
from pulsepanel.operators.labels import churn_label


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --------------------------------------------------------------------- Spark

def supplier_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(
        F.col("l_suppkey").alias("msno"),
        period_of_timestamp("l_shipdate").alias("safra"),
        index_of_timestamp("l_shipdate").alias("month_idx"),
    ).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum("l_quantity").alias("qty"),
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("price_cents"),
        F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("n_returned"),
        F.max((F.col("l_returnflag") == "N").cast("int")).alias("is_ativo"),
    )


def returns_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R")
    return li.groupBy(
        F.col("l_suppkey").alias("msno"),
        period_of_timestamp("l_shipdate").alias("safra"),
    ).agg(
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("returned_cents"),
        F.count(F.lit(1)).alias("ret_lines"),
        F.max("l_tax").alias("max_tax"),
    )


def censored_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    sp = supplier_panel(spark, sf_dir).where(F.col("safra") != 199806)
    return sp.withColumn(
        "is_ativo",
        F.when(F.col("safra").between(199601, 200106), F.col("is_ativo")).otherwise(0))


def order_txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    amount = F.floor(F.col("o_totalprice")).cast("double")
    prio = F.col("o_orderpriority")
    return o.select(
        F.col("o_custkey").alias("msno"),
        period_of_timestamp("o_orderdate").alias("safra"),
        F.col("o_orderkey").alias("_ord"),
        amount.alias("actual_amount_paid"),
        F.when(F.col("o_orderstatus") != "O", amount).alias("plan_list_price"),
        F.when(prio != "5-LOW", F.substring(prio, 1, 1).cast("double") * 30).alias("payment_plan_days"),
        F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", 0.0)
        .alias("is_auto_renew"),
        (F.col("o_orderstatus") == "P").cast("double").alias("is_cancel"),
    )


# Fixed mapping of event types onto the five play-completion buckets.
EVENT_BUCKETS = {"view": "num_25", "click": "num_50", "signup": "num_75",
                 "purchase": "num_985", "error": "num_100"}


def usage_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    cols = [(F.col("event_type") == t).cast("double").alias(b) for t, b in EVENT_BUCKETS.items()]
    return e.select(
        "event_id",
        F.col("user_id").alias("msno"),
        F.date_format("ts", "yyyyMMdd").cast("int").alias("safra"),
        day_index("ts").alias("day_idx"),
        *cols,
        F.lit(1.0).alias("num_unq"),
        F.round(F.col("value") * 100).alias("total_secs"),
    )


def line_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem ⋈ orders as play logs of a customer: one play per line, its
    completion bucket from the quantity, seconds from the price."""
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    j = li.join(o, li.l_orderkey == o.o_orderkey, "inner")
    q = F.col("l_quantity")
    buckets = [(q <= 10), (q > 10) & (q <= 20), (q > 20) & (q <= 30), (q > 30) & (q <= 40), (q > 40)]
    return j.select(
        F.col("o_custkey").alias("msno"),
        period_of_timestamp("l_shipdate").alias("safra"),
        *[c.cast("double").alias(b) for c, b in zip(buckets, EVENT_BUCKETS.values())],
        F.lit(1.0).alias("num_unq"),
        F.round(F.col("l_extendedprice")).alias("total_secs"),
    )


def member_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey, "inner")
    return j.select(
        F.col("o_custkey").alias("msno"),
        period_of_timestamp("o_orderdate").alias("safra"),
        F.col("o_orderkey").alias("_ord"),
        F.col("c_nationkey").cast("string").alias("city"),
        F.floor(F.col("c_acctbal") / 100).cast("double").alias("bd"),
        F.when(F.col("o_orderpriority") != "1-URGENT", F.col("c_mktsegment")).alias("gender"),
        F.col("o_orderpriority").alias("registered_via"),
        F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", 0.0)
        .alias("is_ativo"),
    )


def member_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("msno"),
        F.col("c_nationkey").cast("string").alias("city"),
        F.floor(F.col("c_acctbal") / 100).cast("double").alias("bd"),
        F.col("c_mktsegment").alias("gender"),
    )


def score_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = churn_label(supplier_panel(spark, sf_dir), idx="month_idx")
    p = ((F.col("msno") * 7919 + F.col("month_idx").cast("bigint") * 104729) % 1000) / F.lit(1000.0)
    return lab.where(F.col("is_ativo") == 1).select(
        "msno", "safra", "month_idx", "churn_3m", p.cast("double").alias("p_churn"))


def segment_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_frame(spark, sf_dir).withColumn("cluster", (F.col("msno") % 4).cast("int"))


def vector_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def doc_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    # words are counted before the join, so no text is shuffled
    d = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("n_chars").cast("double").alias("n_chars"),
        F.size(F.split(F.trim(F.col("text")), r"\s+")).cast("double").alias("n_words"), "lang", "source")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return d.join(lab, "doc_id", "left").select(
        "doc_id", "n_chars", "n_words", "lang", "source", "quality", "toxic")


# -------------------------------------------------------------- DuckDB text
# Each snippet is a SELECT usable as a CTE body.

SQL_SUPPLIER_PANEL = """
select l_suppkey as msno,
       cast(year(l_shipdate)*100 + month(l_shipdate) as integer) as safra,
       cast(year(l_shipdate)*12 + month(l_shipdate) - 1 as integer) as month_idx,
       count(*) as n_lines,
       sum(l_quantity) as qty,
       cast(sum(cast(round(l_extendedprice*100) as bigint)) as bigint) as price_cents,
       count(case when l_returnflag = 'R' then 1 end) as n_returned,
       cast(max(case when l_returnflag = 'N' then 1 else 0 end) as integer) as is_ativo
from lineitem group by 1, 2, 3
"""

SQL_RETURNS_PANEL = """
select l_suppkey as msno,
       cast(year(l_shipdate)*100 + month(l_shipdate) as integer) as safra,
       cast(sum(cast(round(l_extendedprice*100) as bigint)) as bigint) as returned_cents,
       count(*) as ret_lines,
       max(l_tax) as max_tax
from lineitem where l_returnflag = 'R' group by 1, 2
"""

SQL_CENSORED_PANEL = f"""
select msno, safra, month_idx, n_lines, qty, price_cents, n_returned,
       case when safra between 199601 and 200106 then is_ativo else 0 end as is_ativo
from ({SQL_SUPPLIER_PANEL}) sp where safra <> 199806
"""

SQL_ORDER_TXN = """
select o_custkey as msno,
       cast(year(o_orderdate)*100 + month(o_orderdate) as integer) as safra,
       o_orderkey as _ord,
       cast(floor(o_totalprice) as double) as actual_amount_paid,
       case when o_orderstatus <> 'O' then cast(floor(o_totalprice) as double) end as plan_list_price,
       case when o_orderpriority <> '5-LOW'
            then cast(substr(o_orderpriority, 1, 1) as double) * 30 end as payment_plan_days,
       case when o_orderstatus = 'F' then 1.0::double
            when o_orderstatus = 'O' then 0.0::double end as is_auto_renew,
       case when o_orderstatus = 'P' then 1.0::double else 0.0::double end as is_cancel
from orders
"""

SQL_USAGE_LOGS = """
select event_id, user_id as msno,
       cast(strftime(ts, '%Y%m%d') as integer) as safra,
       cast(date_diff('day', date '1970-01-01', cast(ts as date)) as integer) as day_idx,
       case when event_type = 'view' then 1.0 else 0.0 end::double as num_25,
       case when event_type = 'click' then 1.0 else 0.0 end::double as num_50,
       case when event_type = 'signup' then 1.0 else 0.0 end::double as num_75,
       case when event_type = 'purchase' then 1.0 else 0.0 end::double as num_985,
       case when event_type = 'error' then 1.0 else 0.0 end::double as num_100,
       1.0::double as num_unq,
       round(value * 100)::double as total_secs
from events
"""

SQL_LINE_LOGS = """
select o_custkey as msno,
       cast(year(l_shipdate)*100 + month(l_shipdate) as integer) as safra,
       case when l_quantity <= 10 then 1.0 else 0.0 end::double as num_25,
       case when l_quantity > 10 and l_quantity <= 20 then 1.0 else 0.0 end::double as num_50,
       case when l_quantity > 20 and l_quantity <= 30 then 1.0 else 0.0 end::double as num_75,
       case when l_quantity > 30 and l_quantity <= 40 then 1.0 else 0.0 end::double as num_985,
       case when l_quantity > 40 then 1.0 else 0.0 end::double as num_100,
       1.0::double as num_unq,
       round(l_extendedprice)::double as total_secs
from lineitem join orders on l_orderkey = o_orderkey
"""

SQL_MEMBER_ROWS = """
select o_custkey as msno,
       cast(year(o_orderdate)*100 + month(o_orderdate) as integer) as safra,
       o_orderkey as _ord,
       cast(c_nationkey as varchar) as city,
       cast(floor(c_acctbal / 100) as double) as bd,
       case when o_orderpriority <> '1-URGENT' then c_mktsegment end as gender,
       o_orderpriority as registered_via,
       case when o_orderstatus = 'F' then 1.0::double
            when o_orderstatus = 'O' then 0.0::double end as is_ativo
from orders join customer on o_custkey = c_custkey
"""

SQL_MEMBER_ATTRS = """
select c_custkey as msno, cast(c_nationkey as varchar) as city,
       cast(floor(c_acctbal / 100) as double) as bd, c_mktsegment as gender
from customer
"""

SQL_SCORE_FRAME = f"""
select a.msno, a.safra, a.month_idx,
       cast(case when a.is_ativo = 1 and f.is_ativo = 0 then 1 else 0 end as integer) as churn_3m,
       ((a.msno * 7919 + cast(a.month_idx as bigint) * 104729) % 1000) / 1000.0::double as p_churn
from ({SQL_SUPPLIER_PANEL}) a
join ({SQL_SUPPLIER_PANEL}) f on f.msno = a.msno and f.month_idx = a.month_idx + 3
where a.is_ativo = 1
"""

SQL_SEGMENT_FRAME = f"""
select *, cast(msno % 4 as integer) as cluster from ({SQL_SCORE_FRAME}) s
"""
