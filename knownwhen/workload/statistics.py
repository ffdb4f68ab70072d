"""Correlations, regressions on Gram matrices, tests and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import timeaxis as T
from ..operators import stats as S
from ..operators.resample import block_bootstrap
from ..session import cut_lineage
from .evaluation import BLOCKS, PREDS, naive_predictions
from .quality import WIDE, wide_hours
from .registry import DAILY_ORDERS, HOURLY, daily_orders, exact_sum, hourly, query, rounded, swept

_LONG = """u AS (SELECT l_returnflag, l_linestatus, l_extendedprice AS y, 'l_quantity' AS feature, l_quantity AS x FROM lineitem UNION ALL SELECT l_returnflag, l_linestatus, l_extendedprice, 'l_discount', l_discount FROM lineitem
  UNION ALL SELECT l_returnflag, l_linestatus, l_extendedprice, 'l_tax', l_tax FROM lineitem)"""
XS = ["l_quantity", "l_discount", "l_tax"]


def f_tail_sql(f: str, d1: str, d2: str, points: int = 4000) -> str:
    """SQL: P(F > f) by Simpson's rule over the angle whose squared sine is the beta variate."""
    end = f"asin(sqrt({d2} / ({d2} + {d1} * {f})))"
    inner = f"list_sum(list_transform(range(1, {points} + 1), lambda k: (CASE WHEN k = {points} THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * exp(({d2} - 1) * ln(sin({end} * k / {points})) + ({d1} - 1) * ln(cos({end} * k / {points})))))"
    return f"2 * exp(lgamma(({d1} + {d2}) / 2.0) - lgamma({d1} / 2.0) - lgamma({d2} / 2.0)) * {end} / {points} / 3 * {inner}"


def _granger_sql() -> str:
    lags = ", ".join(f"lag(price, {k}) OVER w AS y{k}, lag(n, {k}) OVER w AS x{k}" for k in range(1, 5))
    parts = [f"WITH {DAILY_ORDERS}, l AS (SELECT priority, price AS y, n AS x, {lags} FROM daily WINDOW w AS (PARTITION BY priority ORDER BY day))"]
    results = []
    for size in (1, 2, 4):
        for y, x in ("yx", "xy"):
            own, other = [f"{y}{k}" for k in range(1, size + 1)], [f"{x}{k}" for k in range(1, size + 1)]
            centred = ", ".join(f"{c}::DOUBLE - avg({c}::DOUBLE) OVER (PARTITION BY priority) AS {c}" for c in (y, *own, *other))
            parts.append(f"d{y}{size} AS (SELECT priority, {centred} FROM l WHERE {' AND '.join(f'{c} IS NOT NULL' for c in own + other)})")
            parts.append(swept(f"s{y}{size}_", f"d{y}{size}", "priority", y, own + other))
            few, full = f"s{y}{size}_{size}", f"s{y}{size}_{2 * size}"
            results.append(f"""SELECT a.priority, '{"price" if y == "y" else "n_"}' AS target, '{"n_" if y == "y" else "price"}' AS driver, {size} AS lags, a.n, (a.r - b.r) / {size} / (b.r / (a.n - {2 * size + 1})) AS f
FROM (SELECT priority, count(*) AS n, sum({y} * {y}) AS r FROM {few} GROUP BY 1) a JOIN (SELECT priority, sum({y} * {y}) AS r FROM {full} GROUP BY 1) b USING (priority) WHERE a.n >= 30""")
    tests = "\nUNION ALL ".join(results)
    return ",\n".join(parts) + f""", t AS ({tests}), p AS (SELECT *, {f_tail_sql("f", "lags", "(n - 2 * lags - 1)")} AS p FROM t),
r AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p) AS q FROM p)
SELECT priority, target, driver, lags, n, round(f, 4) AS f_stat, round(p, 4) AS p_value, round(least(1, min(q) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 4) AS q_bh FROM r"""


def _break_sql() -> str:
    """The model has four regressors; each coefficient is read where its regressor is swept last."""
    x = ["a", "b", "a_post", "b_post"]
    parts = [f"""WITH {DAILY_ORDERS}, r AS (SELECT priority, (dayofweek(day) + 6) % 7 AS dow, price AS y, n::DOUBLE AS a, datediff('day', DATE '1970-01-01', day)::DOUBLE AS b, CASE WHEN day >= DATE '1998-06-11' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS post FROM daily),
d AS (SELECT priority, {', '.join(f'{e} - avg({e}) OVER w AS {n}' for n, e in (("y", "y"), ("a", "a"), ("b", "b"), ("a_post", "a * post"), ("b_post", "b * post")))} FROM r WINDOW w AS (PARTITION BY priority, dow))"""]
    for j in range(4):
        parts.append(swept(f"o{j}_", "d", "priority", "y", [*[v for k, v in enumerate(x) if k != j], x[j]] if j != 3 else x))
    coefficient = lambda j: f"(SELECT b_y FROM o{j}_c4 z WHERE z.priority = f.priority)"
    both = [f"SELECT f.priority, '{name}' AS feature, round({coefficient(j)}, 5) AS slope_before, round({coefficient(2 + j)}, 5) AS slope_change, f.joint_f, f.n FROM f" for j, name in enumerate(("n_", "trend"))]
    parts.append("""f AS (SELECT a.priority, a.n, round((a.r - b.r) / 2 / (b.r / (a.n - 4)), 4) AS joint_f FROM (SELECT priority, count(*) AS n, sum(y * y) AS r FROM o3_2 GROUP BY 1) a JOIN (SELECT priority, sum(y * y) AS r FROM o3_4 GROUP BY 1) b USING (priority))""")
    return ",\n".join(parts) + "\n" + " UNION ALL ".join(both)


@query("driver_corr", f"""WITH {_LONG}, r AS (SELECT *, rank() OVER (PARTITION BY l_returnflag, feature ORDER BY x) + (count(*) OVER (PARTITION BY l_returnflag, feature, x) - 1) / 2 AS rx,
  rank() OVER (PARTITION BY l_returnflag, feature ORDER BY y) + (count(*) OVER (PARTITION BY l_returnflag, feature, y) - 1) / 2 AS ry FROM u)
SELECT l_returnflag, feature, count(*) AS n, round(corr(rx, ry), 6) AS spearman, round(corr(x, y), 6) AS pearson, count(DISTINCT x) AS n_distinct FROM r GROUP BY 1, 2""")
def driver_corr(t):
    return rounded(S.driver_correlations(t("lineitem"), ["l_returnflag"], "l_extendedprice", XS))


@query("within_group_corr", f"""WITH {_LONG}, r AS (SELECT *, rank() OVER (PARTITION BY l_returnflag, l_linestatus, feature ORDER BY x) + (count(*) OVER (PARTITION BY l_returnflag, l_linestatus, feature, x) - 1) / 2 AS rx,
  rank() OVER (PARTITION BY l_returnflag, l_linestatus, feature ORDER BY y) + (count(*) OVER (PARTITION BY l_returnflag, l_linestatus, feature, y) - 1) / 2 AS ry FROM u),
d AS (SELECT l_returnflag, feature, x AS x0, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y, rx - avg(rx) OVER w AS rx, ry - avg(ry) OVER w AS ry FROM r WINDOW w AS (PARTITION BY l_returnflag, l_linestatus, feature))
SELECT l_returnflag, feature, count(*) AS n, round(corr(rx, ry), 6) AS spearman, round(corr(x, y), 6) AS pearson, count(DISTINCT x0) AS n_distinct, 1.0::DOUBLE AS varying FROM d GROUP BY 1, 2""")
def within_group_corr(t):
    return rounded(S.driver_correlations(t("lineitem"), ["l_returnflag"], "l_extendedprice", XS, ["l_linestatus"], min_varying=0.8))


@query("corr_stability", f"""WITH {_LONG.replace('SELECT l_returnflag', 'SELECT year(l_shipdate) AS yr, l_returnflag')}, p AS (SELECT l_returnflag, feature, corr(x, y) AS pooled FROM u GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY abs(pooled) DESC, feature) AS rank FROM p),
y AS (SELECT l_returnflag, feature, yr, corr(x, y) AS r FROM u GROUP BY 1, 2, 3)
SELECT y.l_returnflag, y.feature, k.rank, round(any_value(k.pooled), 6) AS pooled, count(r) AS periods, round(avg(CASE WHEN sign(r) = sign(k.pooled) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS same_sign, round(min(r), 6) AS r_min, round(max(r), 6) AS r_max
FROM y JOIN k ON k.l_returnflag = y.l_returnflag AND k.feature = y.feature WHERE k.rank <= 2 GROUP BY 1, 2, 3""")
def corr_stability(t):
    out = S.corr_stability(t("lineitem"), ["l_returnflag"], "l_extendedprice", XS, F.year("l_shipdate"), 2)
    return rounded(out.withColumn("rank", F.col("rank").cast("long")))


@query("corr_matrix", f"""WITH {WIDE} SELECT 'click' AS a, 'view' AS b, round(corr(click, view), 6) AS r FROM wide UNION ALL SELECT 'click', 'error', round(corr(click, error), 6) FROM wide UNION ALL SELECT 'view', 'error', round(corr(view, error), 6) FROM wide""")
def corr_matrix(t):
    return rounded(S.corr_matrix(wide_hours(t), ["click", "view", "error"]))


@query("level_shape_corr", f"""WITH {WIDE}, x AS (SELECT CAST(day(hour) // 16 AS BIGINT) AS half, date_trunc('day', hour) AS day, click AS a, view AS b FROM wide WHERE click IS NOT NULL AND view IS NOT NULL), c AS (SELECT half, a, b, a - avg(a) OVER w AS aw, b - avg(b) OVER w AS bw FROM x WINDOW w AS (PARTITION BY day)), d AS (SELECT half, day, avg(a) AS a, avg(b) AS b FROM x GROUP BY 1, 2)
SELECT half, round(r_all, 6) AS r_all, round(r_within_day, 6) AS r_within_day, round(r_daily, 6) AS r_daily, days FROM (SELECT half, corr(a, b) AS r_all, corr(aw, bw) AS r_within_day FROM c GROUP BY 1) JOIN (SELECT half, corr(a, b) AS r_daily, count(*) AS days FROM d GROUP BY 1) USING (half)""")
def level_shape_corr(t):
    w = wide_hours(t).withColumn("half", F.floor(F.dayofmonth("hour") / 16))
    return rounded(S.level_shape_corr(w, ["half"], "click", "view", F.date_trunc("day", "hour")))


@query("gram_matrix", """SELECT l_returnflag, count(*) AS n, CAST(count(*) AS DOUBLE) AS g00, sum(l_quantity) AS g01, round(sum(l_discount), 2) AS g02, sum(l_quantity * l_quantity) AS g11, round(sum(l_quantity * l_discount), 2) AS g12, round(sum(l_discount * l_discount), 4) AS g22 FROM lineitem GROUP BY 1""")
def gram_matrix(t):
    m = S.gram(t("lineitem"), ["l_quantity", "l_discount"], ["l_returnflag"], intercept=True)
    at = lambda i, j, d: F.round(F.col("g")[3 * i + j], d).alias(f"g{i}{j}")
    return m.select("l_returnflag", "n", at(0, 0, 0), at(0, 1, 0), at(0, 2, 2), at(1, 1, 0), at(1, 2, 2), at(2, 2, 4))


_PRUNED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "twice", "gappy", "flat", "mixed"]
_PRUNED_SQL = ", ".join(f"('{a}', '{b}', (SELECT corr({a}, {b}) FROM x))" for i, a in enumerate(_PRUNED) for b in _PRUNED[:i])


@query("column_report", f"""WITH RECURSIVE x AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_linenumber, 2 * l_quantity AS twice, CASE WHEN l_orderkey % 4 = 0 THEN l_tax END AS gappy, 1.0::DOUBLE AS flat,
  CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE l_discount + l_tax END AS mixed FROM lineitem),
c(position, name, missing, sd, distinct_) AS ({" UNION ALL ".join(f"SELECT {i}, '{c}', avg(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), stddev_samp({c}), count(DISTINCT {c}) FROM x" for i, c in enumerate(_PRUNED))}),
r(a, b, r) AS (VALUES {_PRUNED_SQL}), u AS (SELECT c.*, missing <= 0.2 AND distinct_ >= 3 AND sd > 1e-9 AS usable, (SELECT list(b) FROM r WHERE a = c.name AND abs(r) > 0.8) AS near FROM c),
k AS (SELECT -1 AS position, NULL::VARCHAR AS name, NULL::VARCHAR AS copy_of, false AS kept, []::VARCHAR[] AS names
  UNION ALL SELECT u.position, u.name, CASE WHEN usable THEN e.copy END, usable AND e.copy IS NULL, CASE WHEN usable AND e.copy IS NULL THEN list_append(k.names, u.name) ELSE k.names END
  FROM k JOIN u ON u.position = k.position + 1, LATERAL (SELECT list_filter(k.names, lambda n: list_contains(coalesce(u.near, []::VARCHAR[]), n))[1] AS copy) e)
SELECT u.position, u.name AS "column", round(missing, 6) AS missing, round(sd, 6) AS sd, usable, copy_of, kept FROM k JOIN u ON u.position = k.position""")
def column_report(t):
    from ..operators.wide import column_report as report

    key = F.col("l_orderkey")
    x = t("lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", (2 * F.col("l_quantity")).alias("twice"), F.when(key % 4 == 0, F.col("l_tax")).alias("gappy"),
                             F.lit(1.0).alias("flat"), F.when(key % 10 != 0, F.col("l_discount") + F.col("l_tax")).alias("mixed"))
    return rounded(report(x, _PRUNED))


@query("fe_slope", """WITH d AS (SELECT l_returnflag, l_extendedprice - avg(l_extendedprice) OVER w AS y, l_quantity - avg(l_quantity) OVER w AS x FROM lineitem WINDOW w AS (PARTITION BY l_returnflag, l_linenumber))
SELECT l_returnflag, 'l_quantity' AS feature, round(sum(x * y) / sum(x * x), 4) AS coef, round(pow(sum(x * y), 2) / sum(x * x) / sum(y * y), 6) AS r2_within, count(*) AS n FROM d GROUP BY 1""")
def fe_slope(t):
    out = S.fe_ols(t("lineitem"), ["l_returnflag"], "l_extendedprice", ["l_quantity"], ["l_linenumber"], select=False)
    return rounded(rounded(out.select("l_returnflag", "feature", "coef", "r2_within", "n"), 4, "coef"), 6, "r2_within")


@query("fe_forward_selection")
def fe_forward_selection(t):
    li = t("lineitem").withColumns({"unit_price": F.col("l_extendedprice") / F.col("l_quantity"), "net": F.col("l_extendedprice") * (1 - F.col("l_discount"))})
    return S.fe_ols(li, ["l_returnflag"], "unit_price", [*XS, "net"], ["l_linenumber", "l_linestatus"])


@query("newey_west", f"""WITH {DAILY_ORDERS}, d AS (SELECT priority, day, price - avg(price) OVER w AS y, n - avg(n) OVER w AS x FROM daily WINDOW w AS (PARTITION BY priority)),
b AS (SELECT priority, sum(x * y) / sum(x * x) AS b, sum(x * x) AS q, count(*) AS n FROM d GROUP BY 1),
u AS (SELECT d.priority, x * (y - b.b * x) AS u, row_number() OVER (PARTITION BY d.priority ORDER BY day) AS i FROM d JOIN b USING (priority)),
m AS (SELECT u.priority, sum(u.u * v.u * CASE WHEN u.i = v.i THEN 1.0::DOUBLE ELSE 2 * (1 - (u.i - v.i) / 8.0::DOUBLE) END) AS m FROM u JOIN u v ON v.priority = u.priority AND u.i - v.i BETWEEN 0 AND 7 GROUP BY 1)
SELECT priority, 'n___w' AS feature, round(b, 6) AS coef, round(sqrt(m / q / q * n / greatest(n - 1, 1)), 6) AS se, round(b / sqrt(m / q / q * n / greatest(n - 1, 1)), 5) AS t, n FROM b JOIN m USING (priority)""")
def newey_west(t):
    d = daily_orders(t).withColumn("n_", F.col("n").cast("double"))
    from ..operators.shaping import within

    d = within(d, ["priority"], ["price", "n_"])
    return rounded(rounded(S.newey_west(d, ["priority"], "day", "price__w", ["n___w"], 7, "365 days"), 5, "t"), 6, "coef", "se")


@query("granger_f", _granger_sql())
def granger_f(t):
    return rounded(S.granger(daily_orders(t).withColumn("n_", F.col("n").cast("double")), ["priority"], "day", "price", ["n_"], [1, 2, 4], both=True, chunk="365 days"), 4)


@query("break_test", _break_sql())
def break_test(t):
    d = daily_orders(t).withColumns({"n_": F.col("n").cast("double"), "trend": F.unix_date("day").cast("double"), "dow": F.weekday("day")})
    out = S.break_test(d, ["priority"], "day", "price", ["n_", "trend"], F.col("day") >= F.lit("1998-06-11").cast("date"), ["dow"])
    return rounded(rounded(out, 4, "joint_f"), 5, "slope_before", "slope_change")


_STUDY = f"""WITH {DAILY_ORDERS}, v AS (SELECT priority, design, day, (dayofweek(day) + 6) % 7 AS dow, price AS y, n::DOUBLE AS a, CASE WHEN day >= DATE '1998-06-11' - design THEN n::DOUBLE ELSE 0.0::DOUBLE END AS p
  FROM daily, (SELECT unnest([0, 365, 730]) AS design) WHERE design = 0 OR day < DATE '1998-06-11'),
d AS (SELECT priority, design, day, y - avg(y) OVER w AS y, a - avg(a) OVER w AS a, p - avg(p) OVER w AS p FROM v WINDOW w AS (PARTITION BY priority, design, dow)),
g AS (SELECT priority, design, count(*) AS n, sum(a * a) AS aa, sum(a * p) AS ap, sum(p * p) AS pp, sum(a * y) AS ay, sum(p * y) AS py FROM d GROUP BY 1, 2),
b AS (SELECT *, aa * pp - ap * ap AS det, (ay * pp - py * ap) / (aa * pp - ap * ap) AS b1, (py * aa - ay * ap) / (aa * pp - ap * ap) AS b2 FROM g),
u AS (SELECT d.priority, d.design, a * (y - b1 * a - b2 * p) AS u1, p * (y - b1 * a - b2 * p) AS u2, row_number() OVER (PARTITION BY d.priority, d.design ORDER BY day) AS i FROM d JOIN b USING (priority, design)),
m AS (SELECT u.priority, u.design, sum(w * u.u1 * z.u1) AS m11, sum(w * (u.u1 * z.u2 + u.u2 * z.u1) / 2) AS m12, sum(w * u.u2 * z.u2) AS m22
  FROM u JOIN u z ON z.priority = u.priority AND z.design = u.design AND u.i - z.i BETWEEN 0 AND 7, LATERAL (SELECT CASE WHEN u.i = z.i THEN 1.0::DOUBLE ELSE 2 * (1 - (u.i - z.i) / 8.0::DOUBLE) END AS w) GROUP BY 1, 2),
r AS (SELECT priority, design, n, b1, b2, (ap * ap * m11 - 2 * ap * aa * m12 + aa * aa * m22) / det / det * n / (n - 2) AS var FROM b JOIN m USING (priority, design)),
f AS (SELECT *, b2 * b2 / var AS f FROM r), t AS (SELECT *, {f_tail_sql("f", "1", "(n - 2)")} AS p FROM f), q AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p) AS raw FROM t)
SELECT priority, design, 'n_' AS feature, round(b1, 5) AS slope_before, round(b1 + b2, 5) AS slope_after, round(b2, 5) AS slope_change, round(b2 / sqrt(var), 4) AS t_change, round(f, 4) AS wald_f, n, round(p, 4) AS p_joint,
  round(least(1, min(raw) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 4) AS q_bh FROM q"""


@query("break_study", _STUDY)
def break_study(t):
    d = daily_orders(t).withColumns({"n_": F.col("n").cast("double"), "dow": F.weekday("day")})
    out = S.break_study(d, ["priority"], "day", "price", ["n_"], "1998-06-11", ["dow"], [365, 730], 7, "365 days").drop("p_change")
    return rounded(rounded(out, 5, "slope_before", "slope_after", "slope_change"), 4, "t_change", "wald_f", "p_joint", "q_bh")


@query("before_after", f"""WITH {DAILY_ORDERS}, b AS (SELECT priority, CAST(d AS DATE) AS brk FROM (SELECT DISTINCT priority FROM daily), (SELECT unnest([DATE '1997-06-01', DATE '1998-01-01', DATE '2000-03-01']) AS d)),
l AS (SELECT priority, brk, greatest(brk - 200, coalesce(lag(brk) OVER w, brk - 200)) AS lo, least(brk + 200, coalesce(lead(brk) OVER w, brk + 200)) AS hi FROM b WINDOW w AS (PARTITION BY priority ORDER BY brk)),
s AS (SELECT priority, brk AS break_at, design, brk - shift AS brk, lo - shift AS lo, hi - shift AS hi FROM l, (VALUES ('break', 0), ('placebo', 365)) v(design, shift)),
x AS (SELECT s.priority, break_at, design, CASE WHEN day < brk THEN 'b' ELSE 'a' END AS side, price FROM s JOIN daily d ON d.priority = s.priority AND day >= lo AND day < hi),
g AS (SELECT priority, break_at, design, side, count(*) AS n, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS q2, quantile_cont(price, 0.75) AS q3, stddev_samp(price) / avg(price) AS cv FROM x GROUP BY ALL)
SELECT priority, break_at, design, max(n) FILTER (WHERE side = 'b') AS n_before, max(n) FILTER (WHERE side = 'a') AS n_after, round(max(q2) FILTER (WHERE side = 'b'), 4) AS median_before, round(max(q2) FILTER (WHERE side = 'a'), 4) AS median_after,
  round(max(q3 - q1) FILTER (WHERE side = 'a') - max(q3 - q1) FILTER (WHERE side = 'b'), 3) AS iqr_change, round(max(cv) FILTER (WHERE side = 'a') - max(cv) FILTER (WHERE side = 'b'), 6) AS cv_change,
  round(ln(max(q2) FILTER (WHERE side = 'a') / max(q2) FILTER (WHERE side = 'b')), 6) AS log_median_change FROM g GROUP BY 1, 2, 3""")
def before_after(t):
    d = daily_orders(t)
    at = F.explode(F.array(*[F.lit(x).cast("date") for x in ("1997-06-01", "1998-01-01", "2000-03-01")]))
    b = d.select("priority").distinct().withColumn("at", at)
    out = S.before_after(d, b, ["priority"], "day", "price", "at", 200)
    return rounded(rounded(rounded(out, 4, "median_before", "median_after"), 3, "iqr_change"), 6, "cv_change", "log_median_change")


_P = """p AS (SELECT o_orderpriority AS family, c_nationkey AS test, (hash_p % 100000 + 1) / 100000.0::DOUBLE AS p FROM (
  SELECT o_orderpriority, c_nationkey, CAST('0x' || substr(md5(o_orderpriority || '|' || c_nationkey || '|' || count(*)), 1, 8) AS BIGINT) AS hash_p FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2))"""


def _pvalues(t):
    g = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).groupBy(
        F.col("o_orderpriority").alias("family"), F.col("c_nationkey").alias("test")).agg(F.count(F.lit(1)).alias("n"))
    h = F.conv(F.substring(F.md5(F.concat_ws("|", "family", F.col("test").cast("string"), F.col("n").cast("string"))), 1, 8), 16, 10).cast("long")
    return g.select("family", "test", ((h % 100000 + 1) / 100000.0).alias("p"))


@query("bh_adjust", f"""WITH {_P}, r AS (SELECT *, p * count(*) OVER (PARTITION BY family) / row_number() OVER (PARTITION BY family ORDER BY p) AS raw FROM p)
SELECT family, test, p, round(least(1.0, min(raw) OVER (PARTITION BY family ORDER BY p DESC RANGE UNBOUNDED PRECEDING)), 8)::DOUBLE AS q_bh FROM r""")
def bh_adjust(t):
    return rounded(S.bh(_pvalues(t), "p", ["family"]), 8, "q_bh")


@query("holm_adjust", f"""WITH {_P}, r AS (SELECT *, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p) + 1) * p AS raw FROM p)
SELECT family, test, p, round(least(1.0, max(raw) OVER (PARTITION BY family ORDER BY p RANGE UNBOUNDED PRECEDING)), 8)::DOUBLE AS p_holm FROM r""")
def holm_adjust(t):
    return rounded(S.holm(_pvalues(t), "p", ["family"]), 8, "p_holm")


def _erfc_sql(z: str) -> str:
    """The two-sided normal p-value of ``normal_two_sided`` as SQL."""
    x, t = f"(abs({z}) / sqrt(2))", f"(1 / (1 + 0.3275911::DOUBLE * abs({z}) / sqrt(2)))"
    return (f"({t} * (0.254829592::DOUBLE + {t} * (-0.284496736::DOUBLE + {t} * (1.421413741::DOUBLE + {t} * (-1.453152027::DOUBLE + {t} * 1.061405429::DOUBLE)))) * exp(-{x} * {x}))")


@query("prop_ztest", f"""WITH x AS (SELECT lang, length(text) > 600 AS flag, quality = 1 AS outcome FROM documents JOIN labels USING (doc_id)),
g AS (SELECT lang, count(*) FILTER (WHERE flag AND outcome) AS k1, count(*) FILTER (WHERE flag) AS n1, count(*) FILTER (WHERE NOT flag AND outcome) AS k0, count(*) FILTER (WHERE NOT flag) AS n0 FROM x GROUP BY 1),
z AS (SELECT *, CASE WHEN n1 >= 5 AND n0 >= 5 THEN (k1 / n1 - k0 / n0) / nullif(sqrt((k1 + k0) / (n1 + n0) * (1 - (k1 + k0) / (n1 + n0)) * (1 / n1 + 1 / n0)), 0) END AS z FROM g)
SELECT lang, k1, n1, k0, n0, round(z, 6) AS z, round(k1 / nullif(n1, 0), 6) AS share_on, round(k0 / nullif(n0, 0), 6) AS share_off, round({_erfc_sql('z')}, 6) AS p FROM z""")
def prop_ztest(t):
    x = t("documents").join(t("labels"), "doc_id")
    return rounded(S.ztest(x, ["lang"], F.length("text") > 600, F.col("quality") == 1))


@query("binomial_ztest", f"""WITH g AS (SELECT event_type, date_trunc('week', ts) AS week, count(*) AS n, count(*) FILTER (WHERE value > 50) AS k FROM events GROUP BY 1, 2),
z AS (SELECT *, CASE WHEN n >= 30 THEN (k / n - 0.4::DOUBLE) / sqrt(0.24::DOUBLE / n) END AS z FROM g)
SELECT event_type, week, n, k, round(k / n, 6) AS share, round(z, 6) AS z, round({_erfc_sql('z')}, 6) AS p FROM z""")
def binomial_ztest(t):
    e = t("events").withColumn("week", F.date_trunc("week", "ts").cast("timestamp_ntz"))
    return rounded(S.binomial_ztest(e, ["event_type", "week"], F.col("value") > 50, 0.4))


@query("std_diff", f"""WITH h AS (SELECT event_type, hour, n::DOUBLE AS n, value, total, value > 60 AS ev, CAST(hour(hour) AS INTEGER) AS hr FROM (WITH {HOURLY} SELECT * FROM hourly)),
u AS (SELECT event_type, 'n' AS feature, n - avg(n) OVER (PARTITION BY event_type, hr) AS x, ev FROM h UNION ALL SELECT event_type, 'total', total - avg(total) OVER (PARTITION BY event_type, hr), ev FROM h)
SELECT event_type, feature, count(x) FILTER (WHERE ev) AS n_event, count(x) FILTER (WHERE NOT ev) AS n_other, round(avg(x) FILTER (WHERE ev), 6) AS mean_event, round(avg(x) FILTER (WHERE NOT ev), 6) AS mean_other, round(stddev_samp(x), 6) AS sd,
  round((avg(x) FILTER (WHERE ev) - avg(x) FILTER (WHERE NOT ev)) / stddev_samp(x), 6) AS std_diff FROM u GROUP BY 1, 2""")
def std_diff(t):
    h = hourly(t).withColumns({"n": F.col("n").cast("double"), "hr": F.hour("hour")})
    return rounded(S.std_diff(h, ["event_type"], F.col("value") > 60, ["n", "total"], ["hr"]))


_DM = f"""{BLOCKS}, s AS (SELECT b.priority, b.day, b.price AS y, p.price AS a FROM blocks b ASOF LEFT JOIN blocks p ON p.priority = b.priority AND p.slot = b.slot AND b.t0 >= p.known),
q AS (SELECT b.priority, b.day, p.price AS c FROM blocks b ASOF LEFT JOIN blocks p ON p.priority = b.priority AND b.t0 >= p.known),
d AS (SELECT s.priority, s.day, abs(a - y) - abs(c - y) AS d FROM s JOIN q ON q.priority = s.priority AND q.day = s.day WHERE a IS NOT NULL AND c IS NOT NULL),
m AS (SELECT priority, day, d - avg(d) OVER (PARTITION BY priority) AS e, avg(d) OVER (PARTITION BY priority) AS mu, count(*) OVER (PARTITION BY priority) AS n, row_number() OVER (PARTITION BY priority ORDER BY day) AS i FROM d),
v AS (SELECT a.priority, a.n, a.mu, sum(a.e * b.e * CASE WHEN a.i = b.i THEN 1.0::DOUBLE ELSE 2 * (1 - (a.i - b.i) / 8.0::DOUBLE) END) / a.n AS v FROM m a JOIN m b ON b.priority = a.priority AND b.i BETWEEN a.i - 7 AND a.i GROUP BY 1, 2, 3),
z AS (SELECT *, CASE WHEN n >= 30 AND v > 0 THEN mu / sqrt(v / n) END AS z FROM v)"""


@query("dm_test", f"""WITH {_DM} SELECT priority, n, round(mu, 3) AS mean_diff, round(z, 6) AS stat, round({_erfc_sql('z')}, 6) AS p FROM z""")
def dm_test(t):
    p = naive_predictions(t).where(F.col("prev_slot").isNotNull() & F.col("prev_auction").isNotNull())
    d = p.withColumn("d", F.abs(F.col("prev_slot") - F.col("y")) - F.abs(F.col("prev_auction") - F.col("y")))
    return rounded(rounded(S.dm_test(d, ["priority"], "day", "d", 7), 3, "mean_diff"), 6, "stat", "p")


@query("compare_variants", f"""WITH {PREDS}, c AS (SELECT priority, day, year(day)::VARCHAR AS period, abs(prev_slot - y) AS a, abs(roll_med - y) AS b, abs(prev_auction - y) AS z FROM preds WHERE y IS NOT NULL AND prev_slot IS NOT NULL AND roll_med IS NOT NULL AND prev_auction IS NOT NULL),
e AS (SELECT * FROM c UNION ALL SELECT priority, day, 'all', a, b, z FROM c),
m AS (SELECT priority, period, count(*) AS n, avg(a) AS a, avg(b) AS b, avg(z) AS z, avg(b - a) AS mu FROM e GROUP BY 1, 2),
u AS (SELECT e.priority, e.period, e.b - e.a - mu AS d, row_number() OVER (PARTITION BY e.priority, e.period ORDER BY day) AS i FROM e JOIN m USING (priority, period)),
v AS (SELECT u.priority, u.period, sum(u.d * w.d * CASE WHEN u.i = w.i THEN 1.0::DOUBLE ELSE 2 * (1 - (u.i - w.i) / 8.0::DOUBLE) END) AS v FROM u JOIN u w ON w.priority = u.priority AND w.period = u.period AND u.i - w.i BETWEEN 0 AND 7 GROUP BY 1, 2),
s AS (SELECT m.*, CASE WHEN n >= 30 AND v / n > 0 THEN mu / sqrt(v / n / n) END AS z_ FROM m JOIN v USING (priority, period)), q AS (SELECT priority, z_ AS w FROM s WHERE period = 'all')
SELECT s.priority, period, round(a, 3) AS mae_first, round(b, 3) AS mae_second, round(100 * (1 - a / z), 5) AS skill_first, round(100 * (1 - b / z), 5) AS skill_second, n, round(z_, 5) AS stat,
  CASE WHEN period <> 'all' AND z_ IS NOT NULL AND w IS NOT NULL THEN z_ * w > 0 END AS agrees, CASE WHEN period <> 'all' AND z_ IS NOT NULL AND w IS NOT NULL THEN abs(z_) > 1.959963984540054 END AS sure FROM s JOIN q USING (priority)""")
def compare_variants(t):
    from ..operators.evaluate import compare_variants as compare

    out = compare(naive_predictions(t), ["priority"], "day", "y", "prev_slot", "roll_med", "prev_auction", F.year("day"), 7).drop("p")
    return rounded(rounded(out, 3, "mae_first", "mae_second"), 5, "skill_first", "skill_second", "stat")


@query("bootstrap_ci", f"""WITH d AS (SELECT event_type, date_trunc('day', ts) AS day, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS s, count(*)::DOUBLE AS c FROM events GROUP BY 1, 2),
i AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM d),
k AS (SELECT event_type, b, CAST('0x' || substr(md5('11|' || b || '|' || i), 1, 8) AS BIGINT) % n AS j FROM i, (SELECT unnest(generate_series(0, 199)) AS b)),
m AS (SELECT k.event_type, k.b, sum(s) / sum(c) AS m FROM k JOIN i ON i.event_type = k.event_type AND i.i = k.j GROUP BY 1, 2), e AS (SELECT event_type, sum(s) / sum(c) AS estimate FROM d GROUP BY 1)
SELECT m.event_type, round(any_value(estimate), 6) AS estimate, round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high FROM m JOIN e USING (event_type) GROUP BY 1""")
def bootstrap_ci(t, draws=200):
    e = t("events").withColumn("day", T.floor_time("ts", "1 day"))
    sums = {"s": exact_sum("value"), "c": F.count(F.lit(1)).cast("double")}
    return rounded(block_bootstrap(e, ["event_type"], "day", sums, F.col("s") / F.col("c"), draws, 11))


@query("moving_block_bootstrap", f"""WITH {DAILY_ORDERS}, i AS (SELECT priority, price, row_number() OVER (PARTITION BY priority ORDER BY day) AS i, count(*) OVER (PARTITION BY priority) AS n FROM daily), z AS (SELECT DISTINCT priority, n FROM i),
k AS (SELECT priority, n, b, k, CAST('0x' || substr(md5('5|' || b || '|' || k), 1, 8) AS BIGINT) % greatest(n - 42, 1) AS a FROM z, (SELECT unnest(generate_series(0, 49)) AS b), LATERAL (SELECT unnest(generate_series(0, CAST(ceil(n / 42) AS BIGINT) - 1)) AS k)),
m AS (SELECT k.priority, k.b, sum(i.price) / any_value(k.n) AS m FROM k JOIN i ON i.priority = k.priority AND i.i > k.a AND i.i <= least(k.a + least(42, k.n - k.k * 42), k.n) GROUP BY 1, 2)
SELECT m.priority, any_value(e.n) AS n, round(any_value(e.est), 3) AS estimate, round(quantile_cont(m, 0.025), 3) AS ci_low, round(quantile_cont(m, 0.975), 3) AS ci_high FROM m JOIN (SELECT priority, count(*) AS n, avg(price) AS est FROM daily GROUP BY 1) e USING (priority) GROUP BY 1""")
def moving_block_bootstrap(t, draws=50):
    return rounded(S.moving_block_bootstrap(daily_orders(t), ["priority"], "day", "price", 42, draws, 5), 3)


@query("forecast_quality", f"""WITH {BLOCKS}, s AS (SELECT b.priority, b.day, b.price AS y, p.price AS a FROM blocks b ASOF JOIN blocks p ON p.priority = b.priority AND b.t0 >= p.known)
SELECT priority, year(day) AS year, count(*) AS n, round(corr(y, a), 6) AS r, round(100 * avg(abs(a - y) / abs(y)), 4) AS mape, round(avg(a - y), 3) AS bias, round(avg(CASE WHEN abs(a - y) <= 1e-9 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS share_identical FROM s GROUP BY 1, 2""")
def forecast_quality(t):
    p = naive_predictions(t).withColumn("year", F.year("day"))
    out = S.forecast_quality(p, ["priority", "year"], "y", "prev_auction")
    return rounded(rounded(rounded(out, 6, "r", "share_identical"), 4, "mape"), 3, "bias")


_CONTRIB = """c AS (SELECT l_returnflag AS series, 'l_quantity' AS feature, l_orderkey, l_quantity AS v, (l_quantity - 25) * 100 AS c FROM lineitem UNION ALL SELECT l_returnflag, 'l_discount', l_orderkey, l_discount, (0.05 - l_discount) * 20000 * (1 + l_tax) FROM lineitem)"""


def _contributions(t):
    li = t("lineitem")
    a = li.select(F.col("l_returnflag").alias("series"), F.lit("l_quantity").alias("feature"), F.col("l_quantity").alias("v"), ((F.col("l_quantity") - 25) * 100).alias("c"))
    b = li.select(F.col("l_returnflag").alias("series"), F.lit("l_discount").alias("feature"), F.col("l_discount").alias("v"),
                  ((0.05 - F.col("l_discount")) * 20000 * (1 + F.col("l_tax"))).alias("c"))
    return cut_lineage(a.unionByName(b))


@query("contribution_summary", f"""WITH {_CONTRIB}, m AS (SELECT series, feature, avg(abs(c)) AS mean_abs, count(*) AS n FROM c GROUP BY 1, 2),
r AS (SELECT series, feature, rank() OVER (PARTITION BY series, feature ORDER BY v) + (count(*) OVER (PARTITION BY series, feature, v) - 1) / 2 AS rv, rank() OVER (PARTITION BY series, feature ORDER BY c) + (count(*) OVER (PARTITION BY series, feature, c) - 1) / 2 AS rc FROM c),
d AS (SELECT series, feature, corr(rv, rc) AS direction FROM r GROUP BY 1, 2)
SELECT series, feature, n, round(mean_abs, 4) AS mean_abs, round(mean_abs / sum(mean_abs) OVER (PARTITION BY series), 6) AS share, round(direction, 3) AS direction, row_number() OVER (PARTITION BY series ORDER BY mean_abs DESC, feature) AS rank FROM m JOIN d USING (series, feature)""")
def contribution_summary(t):
    out = S.contribution_summary(_contributions(t), ["series"], "feature", "v", "c")
    return rounded(rounded(rounded(out, 4, "mean_abs"), 6, "share"), 3, "direction")


@query("contribution_deciles", """WITH c AS (SELECT event_type, event_id, value AS v, value * 0.5 - 3 AS c FROM events), b AS (SELECT *, CAST(greatest(0, ceil((row_number() OVER (PARTITION BY event_type ORDER BY v, event_id) - 1) * 10 / (count(*) OVER (PARTITION BY event_type) - 1)) - 1) AS BIGINT) AS bin FROM c)
SELECT event_type AS feature, bin, round(avg(v), 7) AS value, round(avg(c), 7) AS contribution FROM b GROUP BY 1, 2""")
def contribution_deciles(t):
    e = t("events").select(F.col("event_type").alias("feature"), "event_id", F.col("value").alias("v"), (F.col("value") * 0.5 - 3).alias("c"))
    out = S.contribution_dependence(e, [], "feature", "v", "c", "event_id").select("feature", "bin", "value", "contribution")
    return rounded(out, 7)


@query("ratio_table", """WITH r AS (SELECT l_linestatus, l_extendedprice / p_retailprice AS r FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_retailprice <> 0)
SELECT l_linestatus, round(quantile_cont(r, 0.25), 6) AS q25, round(quantile_cont(r, 0.5), 6) AS median, round(quantile_cont(r, 0.75), 6) AS q75, count(*) AS n, round(avg(CASE WHEN r > 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS share_above_1 FROM r GROUP BY 1""")
def ratio_table(t):
    x = t("lineitem").join(t("part"), F.col("p_partkey") == F.col("l_partkey"))
    return rounded(S.ratio_table(x, ["l_linestatus"], "l_extendedprice", "p_retailprice"))


@query("same_partition", """WITH c AS (SELECT o_orderstatus AS a, CASE WHEN o_orderkey % 50 = 0 THEN 'x' ELSE lower(o_orderstatus) END AS b, count(*) AS k FROM orders GROUP BY 1, 2)
SELECT round((SELECT sum(m) FROM (SELECT max(k) AS m FROM c GROUP BY a)) / (SELECT sum(k) FROM c), 8)::DOUBLE AS agree_a, round((SELECT sum(m) FROM (SELECT max(k) AS m FROM c GROUP BY b)) / (SELECT sum(k) FROM c), 8)::DOUBLE AS agree_b, (SELECT count(DISTINCT a) FROM c) AS labels_a, (SELECT count(DISTINCT b) FROM c) AS labels_b""")
def same_partition(t):
    x = t("orders").select(F.col("o_orderstatus").alias("a"), F.when(F.col("o_orderkey") % 50 == 0, "x").otherwise(F.lower("o_orderstatus")).alias("b"))
    return rounded(S.same_partition(x, "a", "b"), 8)


@query("jaccard", """SELECT l_linenumber, count(*) FILTER (WHERE l_discount > 0.05 AND l_tax > 0.04) AS both, count(*) FILTER (WHERE l_discount > 0.05 OR l_tax > 0.04) AS either,
  round(count(*) FILTER (WHERE l_discount > 0.05 AND l_tax > 0.04) / greatest(count(*) FILTER (WHERE l_discount > 0.05 OR l_tax > 0.04), 1), 8) AS jaccard FROM lineitem GROUP BY 1""")
def jaccard(t):
    return rounded(S.jaccard(t("lineitem"), ["l_linenumber"], F.col("l_discount") > 0.05, F.col("l_tax") > 0.04), 8)
