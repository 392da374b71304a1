"""Distributed ordering: exact prefix sums, global top-k, exact quantiles.

``Window.orderBy(x)`` without a partition, ``orderBy().limit(k)`` with a big
k, and the exact ``percentile`` aggregate all funnel the data through a
single task.  Everything here is built on one primitive instead:

1. a value histogram ``h = groupBy(value).agg(count, sums)`` - partial
   aggregation collapses ties, so a score held by a third of all rows is one
   histogram row, not a hot task;
2. ``h`` is range-bucketed with explicit boundaries (approximate quantiles of
   the distinct values; any boundaries are correct, they only balance work);
3. per-bucket totals (at most #buckets rows) give each bucket an offset, and
   a window partitioned by bucket adds the running sum inside it.

Where only some positions are wanted (quantiles, top-k cuts), buckets are
counted first and only those that hold a wanted position are sorted.

The result is, for each distinct value, the exact number of rows (and sums
of weights) at or before it in the requested order.  Top-k, ROC-AUC,
average precision and linear-interpolated quantiles all read it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def default_buckets(spark: SparkSession) -> int:
    try:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    except Exception:  # noqa: BLE001 - conf may be unset or "auto"
        n = 200
    return max(2, n)


def _clean_bounds(vals) -> list[float]:
    return sorted({float(b) for b in (vals or []) if b is not None and math.isfinite(b)})


def _probs(n_buckets: int) -> list[float]:
    return [i / n_buckets for i in range(1, n_buckets)] if n_buckets > 1 else [0.5]


def _valid(df: DataFrame, col: str) -> F.Column:
    """Neither NULL nor NaN (NaN is a missing value)."""
    ok = F.col(col).isNotNull()
    if isinstance(df.schema[col].dataType, (T.FloatType, T.DoubleType)):
        ok = ok & ~F.isnan(F.col(col))
    return ok


def _number(df: DataFrame, col: str) -> F.Column | None:
    """A double that never decreases as ``col`` increases; None for types
    that are compared themselves (strings, binary).  NULLs sort first and
    NaN last."""
    dt = df.schema[col].dataType
    c = F.col(col)
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        v = F.when(F.isnan(c), F.lit(math.inf)).otherwise(c.cast("double"))
    elif isinstance(dt, T.NumericType):
        v = c.cast("double")
    elif isinstance(dt, T.BooleanType):
        v = c.cast("int").cast("double")
    elif isinstance(dt, T.DateType):
        v = F.unix_date(c).cast("double")
    elif isinstance(dt, T.TimestampType):
        v = F.unix_micros(c).cast("double")
    elif isinstance(dt, T.TimestampNTZType):
        # by day and time of day: casts and differences go through the session
        # zone, which is not monotone in a daylight-saving gap
        second = F.expr(f"cast(extract(SECOND FROM `{col}`) as double)")
        v = (F.unix_date(F.to_date(c)) * 86400.0 + F.hour(c) * 3600.0 + F.minute(c) * 60.0 + second)
    elif isinstance(dt, (T.StringType, T.BinaryType)):
        return None
    else:
        raise TypeError(f"cannot range-bucket on {col} of type {dt.simpleString()}")
    return F.coalesce(v, F.lit(-math.inf))


# Values drawn per range bucket to place the boundaries of strings.
SAMPLE_PER_BUCKET = 32


def _sampled_bounds(df: DataFrame, col: str, n_buckets: int) -> list:
    """Boundaries between ranges of ``col``: order statistics of the values
    with the smallest hashes (a bounded, repeatable sample).  Boundaries only
    balance the work; every row is placed by comparing its whole value."""
    n = SAMPLE_PER_BUCKET * n_buckets
    got = (df.select(col).where(F.col(col).isNotNull())
           .orderBy(F.xxhash64(col, F.lit(1)), col).limit(n).collect())
    vals = sorted(bytes(r[0]) if isinstance(r[0], (bytes, bytearray)) else r[0].encode() for r in got)
    raw = isinstance(df.schema[col].dataType, T.BinaryType)
    cuts = sorted({vals[i * len(vals) // n_buckets] for i in range(1, n_buckets)}) if vals else []
    return [bytearray(v) if raw else v.decode() for v in cuts]


def _rank_in(bounds: F.Column, size: int, below) -> F.Column:
    """How many elements of a sorted array satisfy ``below`` (true for a
    prefix of it), looking at about 2·sqrt(size) of them."""
    step = max(1, math.isqrt(size))
    last = F.transform(F.sequence(F.lit(step), F.lit(max(step, size)), F.lit(step)),
                       lambda i: F.get(bounds, i - 1))
    full = F.size(F.filter(last, lambda b: F.coalesce(below(b), F.lit(False))))
    rest = F.slice(bounds, full * step + 1, F.lit(step))
    return (full * step + F.size(F.filter(rest, below))).cast("int")


def _bucketize(h: DataFrame, value: str, bounds: list[float], descending: bool) -> DataFrame:
    """Bucket id (0 first in the requested order) via a JVM binary search."""
    nb = len(bounds) + 1
    if nb == 1:
        return h.withColumn("_bucket", F.lit(0))
    tmp = h.withColumn("_vd", F.col(value).cast("double"))
    b = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol="_vd", outputCol="_ba")
    out = b.transform(tmp).withColumn("_ba", F.col("_ba").cast("int"))
    bucket = (F.lit(nb - 1) - F.col("_ba")) if descending else F.col("_ba")
    return out.withColumn("_bucket", bucket).drop("_vd", "_ba")


def _with_offsets(xb: DataFrame, sums: dict, group=None) -> DataFrame:
    """Join each row with the totals of all earlier buckets (of its group).

    The totals have one row per (group, bucket); the join is left to the
    optimizer and is NULL-safe, so a NULL group keeps its rows.
    """
    gcols = [group] if group else []
    tot = xb.groupBy(*gcols, "_bucket").agg(*[F.sum(e).alias(k) for k, e in sums.items()])
    before = (Window.partitionBy(*gcols).orderBy("_bucket")
              .rowsBetween(Window.unboundedPreceding, -1))
    off = tot.select(*[F.col(g).alias("_og") for g in gcols], F.col("_bucket").alias("_ob"), *[
        F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"_off_{k}") for k in sums])
    on = F.col("_bucket") == F.col("_ob")
    if group:
        on = on & F.col(group).eqNullSafe(F.col("_og"))
    return xb.join(off, on, "left").drop("_ob", "_og")


@dataclass
class Prefix:
    """Histogram with exact running totals in value order.

    ``df`` columns: value, ``n``, each weight sum, ``cum_n`` and ``cum_<w>``
    (inclusive running totals), ``_bucket``.  ``total`` holds N and the
    total of each weight.
    """

    df: DataFrame
    value: str
    weights: tuple
    descending: bool
    total: dict


def value_prefix(df: DataFrame, value: str, weights=(), descending: bool = False,
                 n_buckets: int | None = None, positions=None) -> Prefix:
    """Exact running counts/sums over the distinct values of ``value``.

    Rows with a NULL or NaN value are ignored.  One action computes the
    bucket boundaries (approximate quantiles) and the totals in a single pass
    of partial aggregates.  With ``positions`` (a function of the row count
    that lists 0-based positions in the requested order) a second pass counts
    each bucket, and only the values of buckets that hold a wanted position
    are shuffled and sorted; the running totals of those are exact all the
    same.  The prefix table itself stays lazy.
    """
    spark = df.sparkSession
    n_buckets = n_buckets or default_buckets(spark)
    x = df.where(_valid(df, value))
    st = x.agg(F.percentile_approx(F.col(value).cast("double"), _probs(n_buckets), 10_000).alias("b"),
               F.count(F.lit(1)).alias("n"), *[F.sum(F.col(w)).alias(w) for w in weights]).first()
    total = {"n": int(st["n"]), **{w: (st[w] or 0) for w in weights}}
    bounds = _clean_bounds(st["b"]) if n_buckets > 1 else []
    one = {"n": F.lit(1), **{w: F.col(w) for w in weights}}
    order = F.col(value).desc() if descending else F.col(value).asc()
    run = (Window.partitionBy("_bucket").orderBy(order)
           .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    names = list(one)
    if positions is None:
        h = x.groupBy(value).agg(*[F.sum(e).alias(k) for k, e in one.items()])
        out = _with_offsets(_bucketize(h, value, bounds, descending), {k: F.col(k) for k in names})
    else:
        xb = _bucketize(x, value, bounds, descending)
        # at most one row per bucket
        per = sorted(xb.groupBy("_bucket").agg(*[F.sum(e).alias(k) for k, e in one.items()]).collect(),
                     key=lambda r: r["_bucket"])
        offsets, at = {}, dict.fromkeys(names, 0)
        wanted = sorted(positions(total["n"]))
        for r in per:
            if any(at["n"] <= p < at["n"] + r["n"] for p in wanted):
                offsets[r["_bucket"]] = dict(at)
            at = {k: at[k] + (r[k] or 0) for k in names}
        h = (xb.where(F.col("_bucket").isin(list(offsets)))
             .groupBy("_bucket", value).agg(*[F.sum(e).alias(k) for k, e in one.items()]))
        out = h
        for k in names:
            off = F.coalesce(*[F.when(F.col("_bucket") == b, F.lit(o[k])) for b, o in offsets.items()],
                             F.lit(0))
            out = out.withColumn(f"_off_{k}", off)
    for k in names:
        out = out.withColumn(f"cum_{k}", F.col(f"_off_{k}") + F.sum(k).over(run))
    return Prefix(out.drop(*[f"_off_{k}" for k in names]), value, tuple(weights), descending, total)


def quantile_positions(probs):
    """Positions that linear quantiles of n rows read, as a function of n."""
    def of(n: int) -> set:
        return {f(p * (n - 1)) for p in probs for f in (math.floor, math.ceil)} if n else set()
    return of


# ------------------------------------------------------------------ top-k


def topk_size(n: int, frac: float) -> int:
    """k = max(1, int(n * frac)) in double arithmetic (truncation)."""
    return max(1, int(n * frac))


def ordered_positions(df: DataFrame, order_cols, n_buckets: int | None = None,
                      pos: str = "_pos", group: str | None = None) -> DataFrame:
    """1-based position of each row in a total order (within ``group``).

    ``order_cols`` (ascending) must be unique per group.  Rows are
    range-bucketed on the first order column - which must be the
    high-cardinality one (a customer key, a uniform hash), so one value holds
    a bounded number of rows - numbered inside each bucket, and offset by the
    counts of earlier buckets.  Strings are bucketed by comparing them with
    sampled boundaries, so ids with a common prefix spread as well.
    """
    gcols = [group] if group else []
    order = [F.col(c).asc() for c in order_cols]
    first = order_cols[0]
    n_buckets = n_buckets or default_buckets(df.sparkSession)
    number = _number(df, first)
    if number is None:
        bounds = _sampled_bounds(df, first, n_buckets)
        bucket = F.lit(0)
        if bounds:
            bucket = _rank_in(F.array(*[F.lit(b) for b in bounds]), len(bounds),
                              lambda b: b <= F.col(first))
        xb = df.withColumn("_bucket", F.coalesce(bucket, F.lit(0)))
    else:
        x = df.withColumn("_ok", number)
        st = x.agg(F.percentile_approx(F.col("_ok"), _probs(n_buckets), 10_000).alias("b")).first()
        bounds = _clean_bounds(st["b"]) if n_buckets > 1 else []
        xb = _bucketize(x, "_ok", bounds, False).drop("_ok")
    xb = _with_offsets(xb, {"n": F.lit(1)}, group)
    w = Window.partitionBy(*gcols, "_bucket").orderBy(*order)
    return xb.withColumn(pos, F.col("_off_n") + F.row_number().over(w)).drop("_off_n", "_bucket")


@dataclass
class Cut:
    frac: float
    k: int
    score: float | None     # boundary score (the k-th highest)
    above_n: int            # rows strictly above the boundary score
    above_pos: int          # positives strictly above it
    need: int               # rows to take from the boundary score's ties
    tie_n: int              # rows holding the boundary score
    tie_pos: int = 0        # positives holding the boundary score


def topk_positions(fracs):
    """0-based position of the last row of each top-k, as a function of n."""
    return lambda n: {min(topk_size(n, f), n) - 1 for f in fracs} if n else set()


def topk_cuts(prefix: Prefix, fracs, label: str) -> list[Cut]:
    """Boundary of each top-k (k = max(1, int(N·frac))) from a descending prefix."""
    n_total = int(prefix.total["n"])
    cuts, conds, ks = [], [], {}
    for f in fracs:
        k = topk_size(n_total, f)
        ks[f] = k
        conds.append((F.col("cum_n") >= k) & (F.col("cum_n") - F.col("n") < k))
    if n_total == 0:
        return [Cut(f, ks[f], None, 0, 0, 0, 0) for f in fracs]
    cond = conds[0]
    for c in conds[1:]:
        cond = cond | c
    rows = prefix.df.where(cond).select(
        prefix.value, "n", "cum_n", f"cum_{label}", label).collect()
    for f in fracs:
        k = ks[f]
        if k >= n_total:
            # every row is selected
            cuts.append(Cut(f, n_total, None, n_total, int(prefix.total[label]), 0, 0))
            continue
        r = next(r for r in rows if r["cum_n"] >= k and r["cum_n"] - r["n"] < k)
        above_n = int(r["cum_n"] - r["n"])
        above_pos = int(r[f"cum_{label}"] - (r[label] or 0))
        cuts.append(Cut(f, k, r[prefix.value], above_n, above_pos, k - above_n, int(r["n"]),
                        int(r[label] or 0)))
    return cuts


def _tie_positions(df: DataFrame, score: str, cuts: list[Cut], tie_keys) -> DataFrame | None:
    """Rows at partially-taken boundary scores with their position in the ties."""
    partial = sorted({c.score for c in cuts if c.score is not None and 0 < c.need < c.tie_n})
    if not partial:
        return None
    ties = df.where(F.col(score).isin(partial))
    # Positions inside each boundary score (at most #fractions groups).
    return ordered_positions(ties, list(tie_keys), pos="_tie_pos", group=score)


def topk_counts(df: DataFrame, score: str, label: str, fracs, tie_keys,
                prefix: Prefix | None = None) -> list[dict]:
    """k, TP, FP for each fraction; ties at the boundary broken by ``tie_keys``."""
    prefix = prefix or value_prefix(df.select(score, label), score, weights=(label,),
                                    descending=True, positions=topk_positions(fracs))
    cuts = topk_cuts(prefix, fracs, label)
    ties = _tie_positions(df, score, cuts, tie_keys)
    extra = {}
    if ties is not None:
        partial = [c for c in cuts if c.score is not None and 0 < c.need < c.tie_n]
        aggs = [F.sum(F.when((F.col(score) == F.lit(c.score)) & (F.col("_tie_pos") <= c.need),
                             F.col(label)).otherwise(0)).alias(f"tp{i}")
                for i, c in enumerate(partial)]
        row = ties.agg(*aggs).first()
        for i, c in enumerate(partial):
            extra[c.frac] = int(row[f"tp{i}"] or 0)
    out = []
    for c in cuts:
        if c.score is None:
            tp = c.above_pos
        elif c.need >= c.tie_n:
            tp = c.above_pos + c.tie_pos
        else:
            tp = c.above_pos + extra.get(c.frac, 0)
        out.append({"top_frac": c.frac, "k": c.k, "TP": tp, "FP": c.k - tp})
    return out


def topk_flags(df: DataFrame, score: str, fracs, tie_keys, label: str | None = None,
               prefix: Prefix | None = None, names=None) -> DataFrame:
    """Per-row flags ``top_<pct>`` = row is among the k highest scores.

    Rows strictly above or below every boundary get their flags from literal
    comparisons (a narrow projection); only rows holding a partially-taken
    boundary score are numbered by ``tie_keys`` and unioned back - no join.
    Rows with a NULL or NaN score are kept with flags 0 and do not count
    towards N.
    """
    names = names or [f"top_{round(f * 100):d}" for f in fracs]
    if prefix is None:
        cols = [score] + ([label] if label else [])
        prefix = value_prefix(df.select(*cols).withColumn("_one", F.lit(1)), score,
                              weights=("_one",), descending=True, positions=topk_positions(fracs))
        lab = "_one"
    else:
        lab = prefix.weights[0]
    cuts = topk_cuts(prefix, fracs, lab)
    ties = _tie_positions(df, score, cuts, tie_keys)
    partial_scores = sorted({c.score for c in cuts if c.score is not None and 0 < c.need < c.tie_n})
    valid = _valid(df, score)

    def flag(c: Cut, tie_pos=None):
        if c.score is None:
            return valid.cast("int")
        s = F.lit(c.score)
        if c.need >= c.tie_n:
            hit = F.col(score) >= s
        elif tie_pos is None:
            hit = F.col(score) > s
        else:
            hit = (F.col(score) > s) | ((F.col(score) == s) & (F.col(tie_pos) <= c.need))
        return F.coalesce((hit & valid).cast("int"), F.lit(0))

    base = df
    if partial_scores:
        base = df.where(F.coalesce(~F.col(score).isin(partial_scores), F.lit(True)))
    out = base.select("*", *[flag(c).alias(n) for c, n in zip(cuts, names)])
    if ties is not None:
        t = ties.select(*df.columns, *[flag(c, "_tie_pos").alias(n) for c, n in zip(cuts, names)])
        out = out.unionByName(t)
    return out


# -------------------------------------------------------------- quantiles


def quantiles_from_prefix(prefix: Prefix, probs) -> dict:
    """Linear-interpolated quantiles (pandas / ``quantile_cont``) of the rows."""
    if prefix.descending:
        raise ValueError("quantiles need an ascending prefix")
    n = int(prefix.total["n"])
    if n == 0:
        return {p: None for p in probs}
    targets = set()
    for p in probs:
        pos = p * (n - 1)
        targets.update({math.floor(pos), math.ceil(pos)})
    cond = None
    for j in targets:
        c = (F.col("cum_n") - F.col("n") <= j) & (F.col("cum_n") > j)
        cond = c if cond is None else cond | c
    rows = prefix.df.where(cond).select(prefix.value, "n", "cum_n").collect()

    def at(j):
        r = next(r for r in rows if r["cum_n"] - r["n"] <= j < r["cum_n"])
        return float(r[prefix.value])

    out = {}
    for p in probs:
        pos = p * (n - 1)
        lo, hi = math.floor(pos), math.ceil(pos)
        vlo, vhi = at(lo), at(hi)
        out[p] = vlo + (vhi - vlo) * (pos - lo)
    return out


def exact_quantiles(df: DataFrame, value: str, probs) -> dict:
    """{p: linear-interpolated quantile}.  The column is written once, as
    three passes read it; only buckets that hold a wanted position are sorted."""
    from pulsepanel.sources.sinks import materialize

    x = materialize(df.select(value), "quantile_input")
    return quantiles_from_prefix(value_prefix(x, value, positions=quantile_positions(probs)), probs)


# ------------------------------------------------------- grouped quantiles

def _group_bounds(x: DataFrame, group: str, value: str, nb: int, aggs: dict) -> DataFrame:
    """Written table, one row per group: bucket bounds ``_b`` and ``aggs``."""
    from pulsepanel.sources.sinks import materialize

    q = F.percentile_approx(F.col(value).cast("double"), _probs(nb), 10_000)
    return materialize(
        x.groupBy(F.col(group).alias("_bg")).agg(
            F.array_sort(F.array_distinct(q)).alias("_b"), *[e.alias(k) for k, e in aggs.items()]),
        "group_bounds")


def _group_bucket(x: DataFrame, bounds: DataFrame, group: str, value: str, nb: int,
                  descending: bool = False) -> DataFrame:
    """Adds ``_bucket``: boundaries before the value in the requested order.

    Every row passes here, so the sorted boundaries (at most ``nb``) are
    halved by plain expressions, one projection per halving; lambdas over the
    array would be interpreted row by row."""
    v = F.col(value).cast("double")
    out = x.join(bounds.select("_bg", "_b"), F.col(group) == F.col("_bg")).withColumn("_at", F.lit(0))
    step = 1 << (max(1, nb).bit_length() - 1)
    while step:
        b = F.get("_b", F.col("_at") + (step - 1))
        below = F.coalesce((b <= v) if descending else (b < v), F.lit(False))
        out = out.withColumn("_at", F.col("_at") + F.when(below, F.lit(step)).otherwise(F.lit(0)))
        step //= 2
    rank = (F.size("_b") - F.col("_at")) if descending else F.col("_at")
    return out.withColumn("_bucket", rank.cast("int")).drop("_bg", "_b", "_at")


def grouped_value_prefix(df: DataFrame, group: str, value: str, n_buckets: int | None = None,
                         weights=(), descending: bool = False):
    """Exact running counts (and weight sums) of ``value`` within each ``group``.

    Same construction as :func:`value_prefix` with per-group boundaries, kept
    in a written table and joined.  Returns the lazy prefix DataFrame (``n``,
    ``cum_n``, each weight and ``cum_<w>``) and ``{group: {"n": N, w: total}}``,
    one entry per group: groups are report rows (profiled columns, model
    variants, evaluation sets).
    """
    nb = n_buckets or default_buckets(df.sparkSession)
    x = df.where(_valid(df, value) & F.col(group).isNotNull())
    bounds = _group_bounds(x, group, value, nb, {
        "n": F.count(F.lit(1)), **{w: F.sum(F.col(w)) for w in weights}})
    totals = {r["_bg"]: {"n": int(r["n"]), **{w: (r[w] or 0) for w in weights}}
              for r in bounds.drop("_b").collect()}
    h = x.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"),
                                    *[F.sum(F.col(w)).alias(w) for w in weights])
    hb = _group_bucket(h, bounds, group, value, nb, descending)
    sums = {"n": F.col("n"), **{w: F.col(w) for w in weights}}
    out = _with_offsets(hb, sums, group)
    order = F.col(value).desc() if descending else F.col(value).asc()
    w_run = (Window.partitionBy(group, "_bucket").orderBy(order)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = out.select("*", *[(F.col(f"_off_{k}") + F.sum(k).over(w_run)).alias(f"cum_{k}")
                            for k in sums])
    return out.drop(*[f"_off_{k}" for k in sums]), totals


def grouped_prefix(df: DataFrame, group: str, value: str, n_buckets: int | None = None,
                   weights=()):
    """Ascending grouped prefix; returns (lazy DataFrame, {group: N})."""
    out, totals = grouped_value_prefix(df, group, value, n_buckets, weights)
    return out, {g: t["n"] for g, t in totals.items()}


def grouped_topk_counts(df: DataFrame, group: str, score: str, label: str, fracs, tie_keys,
                        prefix: DataFrame, totals: dict) -> dict:
    """{group: [{top_frac, k, TP, FP}]} for every group in one pass.

    ``prefix`` / ``totals`` come from a descending :func:`grouped_value_prefix`
    weighted by ``label``.  The (group, k) targets are a small broadcast
    table (#groups x #fractions rows); the boundary rows are collected, and
    only rows at partially-taken boundary scores are numbered by
    ``tie_keys`` within their (group, score) - one job for all groups.
    """
    spark = df.sparkSession
    gtype = prefix.schema[group].dataType
    ks = {(g, f): topk_size(t["n"], f) for g, t in totals.items() for f in fracs}
    tdf = spark.createDataFrame(
        [(g, float(f), int(k)) for (g, f), k in ks.items()],
        T.StructType([T.StructField(group, gtype), T.StructField("_f", T.DoubleType()),
                      T.StructField("_k", T.LongType())]))
    hit = prefix.join(F.broadcast(tdf), group).where(
        (F.col("cum_n") >= F.col("_k")) & (F.col("cum_n") - F.col("n") < F.col("_k")))
    rows = {(r[group], r["_f"]): r for r in hit.select(
        group, "_f", score, "n", "cum_n", f"cum_{label}", label).collect()}
    cuts: dict = {}
    for (g, f), k in ks.items():
        n_total = totals[g]["n"]
        if k >= n_total:
            cuts[(g, f)] = Cut(f, n_total, None, n_total, int(totals[g][label] or 0), 0, 0)
            continue
        r = rows[(g, float(f))]
        above_n = int(r["cum_n"] - r["n"])
        cuts[(g, f)] = Cut(f, k, r[score], above_n, int(r[f"cum_{label}"] - (r[label] or 0)),
                           k - above_n, int(r["n"]), int(r[label] or 0))
    partial = {key: c for key, c in cuts.items() if c.score is not None and 0 < c.need < c.tie_n}
    extra = {}
    if partial:
        # (group, fraction, boundary score, rows needed from its ties): at
        # most #groups x #fractions rows, built on the driver and broadcast.
        stype = prefix.schema[score].dataType
        need = spark.createDataFrame(
            [(g, float(f), c.score, int(c.need)) for (g, f), c in partial.items()],
            T.StructType([T.StructField(group, gtype), T.StructField("_f", T.DoubleType()),
                          T.StructField(score, stype), T.StructField("_need", T.LongType())]))
        pairs = spark.createDataFrame(sorted({(g, c.score) for (g, _), c in partial.items()},
                                             key=str),
                                      T.StructType([T.StructField(group, gtype),
                                                    T.StructField(score, stype)]))
        ties = (df.join(F.broadcast(pairs), [group, score], "left_semi")
                .withColumn("_gs", F.struct(F.col(group), F.col(score))))
        pos = ordered_positions(ties, list(tie_keys), pos="_tie_pos", group="_gs")
        tp = (pos.join(F.broadcast(need), [group, score])
              .where(F.col("_tie_pos") <= F.col("_need"))
              .groupBy(group, "_f").agg(F.sum(F.col(label)).alias("_tp")))
        extra = {(r[group], r["_f"]): int(r["_tp"] or 0) for r in tp.collect()}
    out: dict = {}
    for (g, f), c in cuts.items():
        if c.score is None:
            tp = c.above_pos
        elif c.need >= c.tie_n:
            tp = c.above_pos + c.tie_pos
        else:
            tp = c.above_pos + extra.get((g, float(f)), 0)
        out.setdefault(g, []).append({"top_frac": f, "k": c.k, "TP": tp, "FP": c.k - tp})
    return out


def grouped_quantiles(df: DataFrame, group: str, value: str, probs, extra_aggs=None):
    """({group: {p: linear-interpolated quantile}}, {group: {name: aggregate}}).

    The two columns are written once.  Buckets are counted by partial
    aggregates; only rows of buckets that hold a wanted position are shuffled
    and sorted.  ``extra_aggs`` are more aggregates per group over the same
    rows; ``n`` is always among them.
    """
    from pulsepanel.sources.sinks import materialize

    nb = default_buckets(df.sparkSession)
    x = materialize(df.where(_valid(df, value) & F.col(group).isNotNull()).select(group, value),
                    "quantile_input")
    aggs = {"n": F.count(F.lit(1)), **(extra_aggs or {})}
    bounds = _group_bounds(x, group, value, nb, aggs)
    stats = {r["_bg"]: {k: r[k] for k in aggs} for r in bounds.drop("_b").collect()}
    if not stats:
        return {}, {}
    xb = _group_bucket(x, bounds, group, value, nb)
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counted = (xb.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_c"))
               .withColumn("_off", F.coalesce(F.sum("_c").over(before), F.lit(0))))
    spots = F.array_distinct(F.flatten(F.array(*[
        F.array(F.floor(p * (F.col("n") - 1)), F.ceil(p * (F.col("n") - 1))) for p in probs])))
    wanted = bounds.select(F.col("_bg"), F.explode(spots.cast("array<bigint>")).alias("_j"))
    held = (counted.join(wanted, F.col(group) == F.col("_bg"))
            .where((F.col("_off") <= F.col("_j")) & (F.col("_j") < F.col("_off") + F.col("_c"))))
    held = materialize(held.select(F.col(group).alias("_hg"), F.col("_bucket").alias("_hb"), "_off",
                                   "_j"), "quantile_buckets")
    kept = held.select("_hg", "_hb", "_off").distinct()
    run = (Window.partitionBy(group, "_bucket").orderBy(value)
           .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    h = (xb.join(kept, (F.col(group) == F.col("_hg")) & (F.col("_bucket") == F.col("_hb")))
         .groupBy(group, "_bucket", value, "_off").agg(F.count(F.lit(1)).alias("_n"))
         .withColumn("_cum", F.col("_off") + F.sum("_n").over(run)))
    at = held.select("_hg", "_hb", "_j")
    hit = (h.join(at, (F.col(group) == F.col("_hg")) & (F.col("_bucket") == F.col("_hb")))
           .where((F.col("_cum") - F.col("_n") <= F.col("_j")) & (F.col("_j") < F.col("_cum"))))
    found: dict = {}
    for r in hit.select(group, "_j", F.col(value).cast("double").alias("v")).collect():
        found.setdefault(r[group], {})[int(r["_j"])] = float(r["v"])
    return {g: _lerp(found[g], st["n"], probs) for g, st in stats.items()}, stats


def _lerp(by_position: dict, n: int, probs) -> dict:
    out = {}
    for p in probs:
        at = p * (n - 1)
        lo, hi = by_position[math.floor(at)], by_position[math.ceil(at)]
        out[p] = lo + (hi - lo) * (at - math.floor(at))
    return out
