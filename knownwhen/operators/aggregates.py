"""Aggregations: bids, tenders, interval features, panels, breakdowns, profiles, curves."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import match
from ..functions import timeaxis as T
from ..functions.numeric import vwmean
from ..session import WIDE, cut_lineage, spread
from . import ordered as O
from .ranks import quantiles


def dedup(df: DataFrame, keys: Sequence[str], *order: Column, keep: str = "last") -> DataFrame:
    """One row per key: the last (or first) in the given order.

    A map-side ``max_by``, so copies of one key collapse before the shuffle however many there are.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if keep == "last" else F.min_by
    best = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("_kw_row"))
    return best.select(*keys, "_kw_row.*").select(*df.columns)


def summarize_auctions(bids: DataFrame, keys: Sequence[str], offered: str, awarded: str, price: str, settle: str,
                       accepted: Column, extra: Sequence[Column] = ()) -> DataFrame:
    """Capacity bids -> one row per auction."""
    ok = F.coalesce(accepted, F.lit(False))
    p, s, a = F.when(ok, F.col(price)), F.when(ok, F.col(settle)), F.when(ok, F.col(awarded))
    return bids.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_bids"), F.count_if(ok).alias("n_accepted"),
        F.sum(offered).alias("offered_mw"), F.sum(a).alias("awarded_mw"),
        F.min(p).alias("price_bid_min"), F.max(p).alias("price_bid_max"),
        F.max(s).alias("price_settle_max"), F.avg(s).alias("price_settle_mean"),
        F.count_distinct(s).alias("n_settle_prices"), vwmean(p, a).alias("price_bid_vwap"),
        F.sum(s * a).alias("cost"), *extra)


def summarize_bids(bids: DataFrame, keys: Sequence[str], direction: str, offered: str, activated: str,
                   price: str, up: str = "up") -> DataFrame:
    """Energy bids -> one row per delivery period, with the marginal activated price of the direction."""
    on = F.col(activated) > 0
    p, a = F.when(on, F.col(price)), F.when(on, F.col(activated))
    return bids.groupBy(*keys, direction).agg(
        F.count(F.lit(1)).alias("n_bids"), F.count_if(on).alias("n_activated"),
        F.sum(offered).alias("offered_mw"), F.sum(a).alias("activated_mw"),
        F.min(price).alias("price_min"), F.max(price).alias("price_max"),
        vwmean(p, a).alias("act_price_vwap"),
        F.when(F.col(direction) == up, F.max(p)).otherwise(F.min(p)).alias("act_price_marginal"))


def combine_groups(df: DataFrame, key: Sequence[str], order: str, weight: str, weighted: Sequence[str] = (),
                   sums: Sequence[str] = (), mins: Sequence[str] = (), maxs: Sequence[str] = (),
                   firsts: Sequence[str] = (), joined: str | None = None, count: str = "n_members") -> DataFrame:
    """Several tenders of one block -> one row.

    Prices are weighted by the positive weights; sums stay NULL when every member is NULL; the
    remaining columns come from the first member in order. A single member stays as it is.
    """
    w = F.when(F.col(weight) > 0, F.col(weight))
    rank = F.struct(*[F.col(c) for c in [order, *([joined] if joined else [])]])
    single = F.count(F.lit(1)) == 1
    aggs = [F.count(F.lit(1)).alias(count)]
    aggs += [F.when(single, F.first(c)).otherwise(vwmean(F.when(w.isNotNull(), F.col(c)), w)).alias(c) for c in weighted]
    aggs += [F.sum(c).alias(c) for c in sums] + [F.min(c).alias(c) for c in mins] + [F.max(c).alias(c) for c in maxs]
    aggs += [F.min_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c) for c in firsts]
    if joined:
        pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(joined).cast("string").alias("v"))))
        aggs.append(F.array_join(F.transform(pairs, lambda x: x["v"]), "+").alias(joined))
    return df.groupBy(*key).agg(*aggs)


def interval_features(df: DataFrame, by: Sequence[str], bucket: Column, x: Column, thresholds: Sequence[float],
                      clip: float, name: str = "bucket") -> DataFrame:
    """Dispersion, extremes, exceedance shares and one-sided clipped sums of a high-rate deviation."""
    aggs = [F.count(x).alias("n"), F.avg(x).alias("mean"), F.avg(F.abs(x)).alias("mean_abs"),
            F.stddev_samp(x).alias("std"), F.max(F.abs(x)).alias("max_abs"), F.min(x).alias("low"), F.max(x).alias("high"),
            F.sum(F.greatest(F.least(x, F.lit(clip)), F.lit(0.0)) / clip).alias("up_equivalent"),
            F.sum(F.greatest(F.least(-x, F.lit(clip)), F.lit(0.0)) / clip).alias("down_equivalent")]
    aggs += [F.avg((F.abs(x) > t).cast("double")).alias(f"share_outside_{t:g}") for t in thresholds]
    return df.groupBy(*by, bucket.alias(name)).agg(*aggs)


def pivot_sum(df: DataFrame, index: Sequence[str], column: str, value: str, values: Sequence[str]) -> DataFrame:
    """Unstack with sums that stay NULL where there is no row. ``values`` spares Spark a pass to find them."""
    return df.groupBy(*index).pivot(column, list(values)).agg(F.sum(value))


def weighted_panel(panel: DataFrame, weights: DataFrame, station: Sequence[str], by: Sequence[str], value: str,
                   weight: str, min_coverage: float = 0.0) -> DataFrame:
    """Weighted mean over the stations that report, weights renormalised, with the covered share."""
    rows = panel.transform(match, weights, list(station))
    total = weights.agg(F.sum(weight).alias("_kw_all"))
    out = rows.groupBy(*by).agg(F.sum(F.col(value) * F.col(weight)).alias("_kw_s"),
                                F.sum(F.when(F.col(value).isNotNull(), F.col(weight))).alias("_kw_w"))
    out = out.join(F.broadcast(total)).withColumn("coverage", F.coalesce(F.col("_kw_w"), F.lit(0.0)) / F.col("_kw_all"))
    mean = F.col("_kw_s") / F.nullif(F.col("_kw_w"), F.lit(0.0))
    return out.withColumn(value, F.when(F.col("coverage") >= min_coverage, mean)).drop("_kw_s", "_kw_w", "_kw_all")


def shares_of_total(df: DataFrame, by: Sequence[str], within: Sequence[str], value: str, members: str | None = None) -> DataFrame:
    """Share of each group in the total of its parent, optionally split equally among its members."""
    part = df.groupBy(*within, *by).agg(F.sum(value).alias("amount"), *([F.first(members).alias(members)] if members else []))
    whole = part.groupBy(*within).agg(F.sum("amount").alias("_kw_total")) if within else part.agg(F.sum("amount").alias("_kw_total"))
    out = part.transform(match, whole, list(within)) if within else part.join(F.broadcast(whole))
    share = F.col("amount") / F.col("_kw_total")
    return out.withColumn("share", share / F.col(members) if members else share).drop("_kw_total")


def describe_plus(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Moments, shares and exact quantiles per group; no group is gathered for its quantiles."""
    x = F.col(value).cast("double")
    base = df.groupBy(*by).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.max(x).alias("max"),
        F.skewness(x).alias("skew"), F.avg((x <= 0).cast("double")).alias("share_le_0"))
    q = quantiles(df, by, value, {"p05": 0.05, "median": 0.5, "p95": 0.95, "p99": 0.99})
    out = base.transform(match, q, list(by), "left") if by else base.join(F.broadcast(q))
    return out.withColumns({"cv": F.col("std") / F.nullif(F.col("mean"), F.lit(0.0)),
                            "p99_over_median": F.col("p99") / F.nullif(F.col("median"), F.lit(0.0))})


def crosstab(df: DataFrame, rows: str, cols: str, values: Sequence, share: bool = False) -> DataFrame:
    """Counts (or row shares) by two labels, one column per listed value."""
    out = df.groupBy(rows).agg(*[F.count_if(F.col(cols) == v).alias(str(v)) for v in values], F.count(F.lit(1)).alias("n"))
    return out.withColumns({str(v): F.col(str(v)) / F.col("n") for v in values}) if share else out


def relative_profile(df: DataFrame, base: Sequence[str], cell: Sequence[str], value: str) -> DataFrame:
    """Median, per cell, of the value relative to the median of its base group."""
    med = quantiles(df, base, value, {"_kw_base": 0.5})
    rel = df.transform(match, med, list(base)).withColumn("_kw_rel", F.col(value) / F.nullif(F.col("_kw_base"), F.lit(0.0)))
    rel = cut_lineage(rel.select(*cell, "_kw_rel"))
    n = rel.groupBy(*cell).agg(F.count("_kw_rel").alias("n"))
    return quantiles(rel, cell, "_kw_rel", {"relative": 0.5}).transform(match, n, list(cell))


def breakdown(df: DataFrame, dims: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """The same metrics pooled and by each dimension, in one pass over the rows.

    Each row is expanded to (dimension, label) before a map-side aggregate, which is what
    GROUPING SETS does, but it keeps one label column and real NULL labels.
    """
    labels = [F.struct(F.lit("pooled").alias("dimension"), F.lit("all").alias("label"))]
    labels += [F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("label")) for d in dims]
    rows = df.withColumn("_kw_dim", F.explode(F.array(*labels)))
    return rows.groupBy(F.col("_kw_dim.dimension").alias("dimension"), F.col("_kw_dim.label").alias("label")).agg(*aggs)


def latest_revision(df: DataFrame, doc: str, revision: str, status: str | None = None, dropped: Sequence[str] = ()) -> DataFrame:
    """Rows of each document's highest revision after withdrawn statuses are removed."""
    rows = df if status is None else df.where(~F.coalesce(F.col(status).isin(*dropped), F.lit(False)))
    top = rows.groupBy(doc).agg(F.max(F.coalesce(F.col(revision), F.lit(0))).alias("_kw_top"))
    out = rows.transform(match, top, doc)
    return out.where(F.coalesce(F.col(revision), F.lit(0)) == F.col("_kw_top")).drop("_kw_top")


def revision_stats(df: DataFrame, doc: str, revision: str, created: str, start: str, group: Sequence[str] = ()) -> DataFrame:
    """Revisions per document, share known before the start, and the lead of the first revision."""
    # A wide exchange by document: the distinct counts then need no other, and no hash table grows with the table.
    rows = spread(df.select(*{c: None for c in (*group, doc, revision, created, start)}), doc, least=WIDE)
    per = rows.groupBy(*group, doc).agg(
        F.count_distinct(revision).alias("revisions"), F.bool_or(F.col(revision) == 1).alias("has_original"),
        F.min(created).alias("first_created"), F.min(start).alias("starts"))
    lead = (T.micros("starts") - T.micros("first_created")) / T.HOUR
    return per.groupBy(*group).agg(
        F.count(F.lit(1)).alias("documents"), F.avg("revisions").alias("mean_revisions"),
        F.avg(F.col("has_original").cast("double")).alias("share_original"),
        F.avg((F.col("first_created") <= F.col("starts")).cast("double")).alias("share_ex_ante"),
        F.avg(lead).alias("mean_lead_hours"))


def lag_profile(df: DataFrame, by: Sequence[str], start: str, created: str, late_days: float) -> DataFrame:
    """Median publication lag in days per group and whether it marks the group as late."""
    lag = (T.micros(created) - T.micros(start)) / T.DAY
    out = quantiles(df.withColumn("_kw_lag", lag), by, "_kw_lag", {"median_lag_days": 0.5})
    return out.withColumn("late", F.col("median_lag_days") > late_days)


def extreme_counts(df: DataFrame, by: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.count_if(p).alias(n) for n, p in rules.items()])


def availability(df: DataFrame, families: Mapping[str, str], by: Sequence[str]) -> DataFrame:
    """Mean share of present values over the columns of each family."""
    long = df.select(*by, *[F.col(c).isNotNull().cast("double").alias(c) for c in families]).unpivot(
        list(by), list(families), "column", "present")
    family = F.create_map(*[F.lit(x) for kv in families.items() for x in kv])[F.col("column")]
    per = long.groupBy(*by, family.alias("family"), "column").agg(F.avg("present").alias("share"))
    return per.groupBy(*by, "family").agg(F.avg("share").alias("availability"))


def bucket_uniformity(df: DataFrame, by: Sequence[str], bucket: Column, value: str, period: Column,
                      decimals: int = 2) -> DataFrame:
    """Share of buckets whose values are all equal, and the mean range, per period."""
    x = F.round(value, decimals)
    per = df.groupBy(*by, period.alias("period"), bucket.alias("bucket")).agg(
        F.count_distinct(x).alias("nd"), (F.max(x) - F.min(x)).alias("spread"))
    return per.groupBy(*by, "period").agg(
        F.count(F.lit(1)).alias("buckets"), F.avg((F.col("nd") == 1).cast("double")).alias("share_identical"),
        F.avg("spread").alias("mean_range"), F.avg((F.col("spread") == 0).cast("double")).alias("share_zero_range"))


def step_means(windows: DataFrame, grid: DataFrame, start: str, end: str, ts: str, by: Sequence[str], value: str,
               name: str, chunk: str | int = "30 days") -> DataFrame:
    """Mean of a step function over arbitrary ``[start, end)`` windows from prefix sums."""
    from .asof import span_sums

    sums = {"_kw_s": F.col(value).cast("double"), "_kw_n": F.when(F.col(value).isNotNull(), F.lit(1.0))}
    out = span_sums(windows, grid, start, end, ts, by, sums, closed="left", chunk=chunk)
    return out.withColumn(name, F.col("_kw_s") / F.nullif(F.col("_kw_n"), F.lit(0.0))).drop("_kw_s", "_kw_n")


def curve_features(curves: DataFrame, key: Sequence[str], side: str, price: str, volume: str,
                   shifts: Sequence[float] = (0.0, 100.0, 500.0, -100.0, -500.0), price_chunk: int = 1000) -> DataFrame:
    """Crossing of a supply and a demand curve per key, and what a volume shift does to it.

    Input: cumulative volume at each price, side ``sell`` or ``buy``. Both curves are
    interpolated linearly on the union of their prices (flat outside), the excess supply is
    made monotone by a running maximum, and for each shift x the price with excess = x is read
    off the segment that contains it. Prices are processed in chunks, so a key may hold any
    number of curve points. Output columns ``p`` (crossing price), ``q`` (its volume),
    ``dp_<shift>``, and for both sides the room above ``q`` and the inelastic volume.
    """
    per = curves.groupBy(*key, F.col(price).cast("double").alias("p")).agg(
        F.max(F.when(F.col(side) == "sell", F.col(volume))).cast("double").alias("s"),
        F.max(F.when(F.col(side) == "buy", F.col(volume))).cast("double").alias("d"))
    per = cut_lineage(per.withColumn("axis", F.floor(F.col("p") * 10_000).cast("long")))
    chunk = price_chunk * 10_000
    point = {c: F.when(F.col(c).isNotNull(), F.struct(F.col("p").alias("p"), F.col(c).alias("v"))) for c in ("s", "d")}
    rows = O.scan(per, key, "axis", last={f"{c}_lo": e for c, e in point.items()},
                  upcoming={f"{c}_hi": e for c, e in point.items()}, ties=["p"], chunk=chunk)

    def at(c: str) -> Column:
        lo, hi = F.col(f"{c}_lo"), F.col(f"{c}_hi")
        slope = (hi["v"] - lo["v"]) / F.nullif(hi["p"] - lo["p"], F.lit(0.0))
        return F.coalesce(F.col(c), lo["v"] + slope * (F.col("p") - lo["p"]), lo["v"], hi["v"])

    rows = rows.withColumns({"supply": at("s"), "demand": at("d")}).withColumn("_kw_raw", F.col("supply") - F.col("demand"))
    # Running maximum and the point before, inherited across chunks in one pass.
    keyed = O.keyed(rows.drop("s_lo", "s_hi", "d_lo", "d_hi"), key, "axis", chunk)
    here = F.struct("p", "supply")
    keyed = O.inherit(keyed, {"_kw_m": F.max("_kw_raw"), "_kw_at": F.max_by(here, O.position(["p"]))},
                      lambda earlier, _: {"_kw_top": F.max("_kw_m").over(earlier), "_kw_at": F.last("_kw_at").over(earlier)})
    w = O.inside(["p"])
    below = F.greatest(F.max("_kw_raw").over(w.rowsBetween(O.UNBOUNDED, -1)), F.col("_kw_top"))
    before = F.coalesce(F.lag(here, 1).over(w), F.col("_kw_at"))
    rows = O.unkeyed(keyed.withColumns({"E0": below, "_kw_at": before}))
    rows = rows.withColumns({"E": F.greatest("_kw_raw", "E0"), "p0": F.col("_kw_at.p"), "S0": F.col("_kw_at.supply")})

    def solve(x: float) -> tuple[Column, Column]:
        first = (F.col("E") >= x) & (F.col("E0").isNull() | (F.col("E0") < x))
        inner = F.col("p0") + (F.lit(x) - F.col("E0")) * (F.col("p") - F.col("p0")) / (F.col("E") - F.col("E0"))
        hit = F.when(F.col("E0").isNull(), F.col("p")).otherwise(inner)
        return (F.coalesce(F.max(F.when(first, hit)), F.max("p")),
                F.coalesce(F.max(F.when(first, F.when(F.col("E0").isNull(), F.col("supply")).otherwise(
                    F.col("S0") + (F.col("supply") - F.col("S0")) * (inner - F.col("p0"))
                    / F.nullif(F.col("p") - F.col("p0"), F.lit(0.0))))), F.max_by("supply", "p")))

    aggs = [F.max("s").alias("sell_max"), F.max("d").alias("buy_max"), F.min("s").alias("sell_inelastic"),
            F.min("d").alias("buy_inelastic"), F.count("s").alias("_kw_ns"), F.count("d").alias("_kw_nd")]
    p0, q0 = solve(0.0)
    aggs += [p0.alias("p"), q0.alias("q")]
    aggs += [solve(x)[0].alias(f"_kw_x{i}") for i, x in enumerate(shifts) if x]
    out = rows.groupBy(*key).agg(*aggs).where((F.col("_kw_ns") >= 2) & (F.col("_kw_nd") >= 2))
    named = {f"dp_{'m' if x < 0 else 'p'}{abs(x):g}": F.col(f"_kw_x{i}") - F.col("p") for i, x in enumerate(shifts) if x}
    named |= {"sell_room": F.col("sell_max") - F.col("q"), "buy_room": F.col("buy_max") - F.col("q")}
    return out.withColumns(named).select(*key, "p", "q", *named, "sell_inelastic", "buy_inelastic")
