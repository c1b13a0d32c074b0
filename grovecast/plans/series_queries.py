"""Queries over event series (framing, transforms, gaps, thresholds, forecasts) and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.decay import decayed, decayed_sql
from ..operators import framing, gaps, summary, thresholds, transforms

D = 0.01
E_SQL = "(SELECT user_id AS series, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, epoch_us(ts) AS t, value AS x FROM events)"
#: every 11th value, by series, is taken out
H_SQL = f"(SELECT series, seq, t, CASE WHEN (series * 7 + seq) % 11 = 0 THEN NULL ELSE x END AS x FROM {E_SQL})"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def E(spark, sf):
    return framing.series(spark.read.parquet(f"{sf}/events.parquet"), "user_id", ["ts", "event_id"], "value", "ts")


def H(spark, sf):
    return E(spark, sf).withColumn("x", F.when((F.col("series") * 7 + F.col("seq")) % 11 != 0, F.col("x")))


def r3(*names):
    return [F.round(F.col(n), 3).alias(n) for n in names]


def query(name, sql):
    def put(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return put


K = ["series", "seq"]
LAGS = ", ".join(f"lag(x, {3 - i}) OVER o AS s{i}" for i in range(4))


@query("shingle_linear", f"SELECT series, seq, s0, s1, s2, s3 FROM (SELECT series, seq, {LAGS} FROM {E_SQL} WINDOW o AS (PARTITION BY series ORDER BY seq)) WHERE seq >= 4")
def _(spark, sf):
    return framing.shingle(E(spark, sf), 4).select(*K, *(F.col("shingle")[i].alias(f"s{i}") for i in range(4)))


@query(
    "shingle_rotated",
    "SELECT series, seq, " + ", ".join(f"lag(x, ((seq - {i}) % 4)::INTEGER) OVER o AS s{i}" for i in range(4)) + f" FROM {E_SQL} WINDOW o AS (PARTITION BY series ORDER BY seq) QUALIFY seq >= 4",
)
def _(spark, sf):
    return framing.shingle(E(spark, sf), 4, rotate=True).select(*K, *(F.col("shingle")[i].alias(f"s{i}") for i in range(4)))


@query("missing_index_translate", f"SELECT series, seq, i + 9 AS plain, i + (seq % 4) * 3 AS rotated FROM {E_SQL}, (SELECT unnest([0, 2]) AS i)")
def _(spark, sf):
    miss = F.array(F.lit(0), F.lit(2))
    df = E(spark, sf).withColumn("a", framing.missing_indices(miss, 3, 4)).withColumn("b", framing.missing_indices(miss, 3, 4, F.col("seq")))
    return df.select(*K, F.explode(F.arrays_zip("a", "b")).alias("z")).select(*K, F.col("z.a").alias("plain"), F.col("z.b").cast("long").alias("rotated"))


@query("shingle_only_update", f"SELECT series, seq, s0, s1, s2, s3, event_ok AS trains FROM (SELECT series, seq, x > 0 AND seq % 3 <> 0 AS event_ok, {LAGS} FROM {E_SQL} WINDOW o AS (PARTITION BY series ORDER BY seq)) WHERE seq >= 4")
def _(spark, sf):
    df = E(spark, sf).withColumn("ok", (F.col("x") > 0) & (F.col("seq") % 3 != 0))
    return framing.shingle(df, 4, train="ok").select(*K, *(F.col("shingle")[i].alias(f"s{i}") for i in range(4)), "trains")


@query("decayed_mean_dev", f"SELECT series, seq, round(v_w, 3) AS v_w, round(v_mean, 3) AS v_mean, round(v_dev, 3) AS v_dev FROM {decayed_sql('x', D, E_SQL, 'v')}")
def _(spark, sf):
    return decayed(E(spark, sf), "x", D, ["series"], ["seq"], "v").select(*K, *r3("v_w", "v_mean", "v_dev"))


DIFF_SQL = f"(SELECT *, CASE WHEN seq = 1 THEN 0 ELSE x - lag(x) OVER (PARTITION BY series ORDER BY seq) END AS diff FROM {E_SQL})"
FIVE = decayed_sql("change_dev", D / 10, decayed_sql("change_mean", D / 10, decayed_sql("value_dev", D, decayed_sql("diff", D, decayed_sql("x", D, DIFF_SQL, "value"), "change"), "spread"), "drift"), "jump")
FIVE_NAMES = ["value_mean", "value_dev", "change_mean", "change_dev", "spread_mean", "drift_mean", "jump_mean"]


@query("five_running_stats", "SELECT series, seq, " + ", ".join(f"round({n}, 3) AS {n}" for n in FIVE_NAMES) + f" FROM {FIVE}")
def _(spark, sf):
    return transforms.running_statistics(E(spark, sf), D, ["series"], "seq").select(*K, *r3(*FIVE_NAMES))


@query("running_counters", f"SELECT series, count(*) AS updates, count(x) AS seen, max(seq) + 1 AS next_seq, max(seq) >= 64 AS ready FROM {H_SQL} GROUP BY series")
def _(spark, sf):
    return H(spark, sf).groupBy("series").agg(F.count("*").alias("updates"), F.count("x").alias("seen"), (F.max("seq") + 1).alias("next_seq"), (F.max("seq") >= 64).alias("ready"))


def lagged(c, first):
    return f"coalesce(lag({c}) OVER (PARTITION BY series ORDER BY seq), {first})"


Y_SQL = {
    "NONE": (E_SQL, "x"),
    "WEIGHTED": (E_SQL, "2.5 * x"),
    "SUBTRACT_MA": (decayed_sql("x", D, E_SQL, "value"), f"x - {lagged('value_mean', 0)}"),
    "NORMALIZE": (decayed_sql("value_dev", D, decayed_sql("x", D, E_SQL, "value"), "spread"), f"least(greatest((x - {lagged('value_mean', 0)}) / {lagged('abs(spread_mean) + 1', 1)}, -100), 100)"),
    "DIFFERENCE": (DIFF_SQL, "diff"),
    "NORMALIZE_DIFFERENCE": (decayed_sql("diff", D, DIFF_SQL, "change"), f"least(greatest((diff - {lagged('change_mean', 0)}) / {lagged('change_dev + 1', 1)}, -100), 100)"),
}
for _method, (_source, _y) in Y_SQL.items():

    def _run(spark, sf, method=_method):
        return transforms.transform(E(spark, sf), method, D, 2.5 if method == "WEIGHTED" else 1.0).select(*K, *r3("y"))

    def _back(spark, sf, method=_method):
        w = 2.5 if method == "WEIGHTED" else 1.0
        # clipped rows cannot come back
        out = transforms.invert(transforms.transform(E(spark, sf), method, D, w), method, w)
        return out.where(F.abs("y") < 100 if method.startswith("NORMALIZE") else F.lit(True)).select(*K, *r3("back"))

    query(f"transform_{_method.lower()}", f"SELECT series, seq, round({_y}, 3) AS y FROM {_source}")(_run)
    _keep = f"abs(y) < 100" if _method.startswith("NORMALIZE") else "true"
    query(f"inverse_{_method.lower()}", f"SELECT series, seq, round(x, 3) AS back FROM (SELECT series, seq, x, {_y} AS y FROM {_source}) WHERE {_keep}")(_back)


def _forecast(method):
    def run(spark, sf):
        df = E(spark, sf).select(*K, "x").withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(4))))
        df = df.withColumn("y", F.col("h") * 0.5).withColumn("shift", F.lit(1.25)).withColumn("scale", F.lit(2.0)).withColumn("drift", F.lit(0.1)).withColumnRenamed("x", "last")
        return transforms.invert_forecast(df, method, keys=("series", "seq")).select(*K, F.col("h").cast("long").alias("h"), *r3("back"))

    return run


_F = f"(SELECT series, seq, x, h FROM {E_SQL}, (SELECT unnest([1, 2, 3, 4]) AS h))"
query("forecast_invert_plain", f"SELECT series, seq, h::BIGINT AS h, round((h * 0.5 * 2 + 1.25 + h * 0.1)::DOUBLE, 3) AS back FROM {_F}")(_forecast("NORMALIZE"))
query("forecast_invert_difference", f"SELECT series, seq, h::BIGINT AS h, round(x + sum(h * 0.5 * 2 + 1.25) OVER (PARTITION BY series, seq ORDER BY h), 3) AS back FROM {_F}")(_forecast("DIFFERENCE"))

GAP_SQL = f"(SELECT *, coalesce((t - lag(t) OVER (PARTITION BY series ORDER BY seq)) / 1e6, 0) AS gap FROM {E_SQL})"
#: statistics of the gaps: the first row has none
_G1 = decayed_sql("gap", D, f"(SELECT * FROM {GAP_SQL} WHERE seq > 1)", "gap")
GAPS_SQL = f"(SELECT e.series, e.seq, e.t, e.x, e.gap, lag(g.gap_mean) OVER o AS m, lag(g.gap_dev) OVER o AS d FROM {GAP_SQL} e LEFT JOIN {_G1} g ON e.series = g.series AND e.seq = g.seq WINDOW o AS (PARTITION BY e.series ORDER BY e.seq))"


@query("time_augmented", f"SELECT series, seq, x AS p0, round(0.5 * gap, 3) AS p1 FROM {GAP_SQL}")
def _(spark, sf):
    return framing.time_augmented(E(spark, sf), 0.5).select(*K, F.col("point")[0].alias("p0"), F.round(F.col("point")[1], 3).alias("p1"))


@query("time_gap_normalized", f"SELECT series, seq, CASE WHEN seq = 1 THEN 0 ELSE round(least(greatest((gap - coalesce(m, 0)) / (2 * (coalesce(d, 0) + 1e-3)), -100), 100), 3) END AS z FROM {GAPS_SQL}")
def _(spark, sf):
    return transforms.time_normalized(E(spark, sf), D).select(*K, *r3("z"))


@query("time_inverse", f"SELECT series, seq, t AS back FROM {GAPS_SQL} WHERE seq > 3 AND abs((gap - m) / (2 * (d + 1e-3))) < 100")
def _(spark, sf):
    from pyspark.sql import Window

    o = Window.partitionBy("series").orderBy("seq")
    df = transforms.time_normalized(E(spark, sf), D)
    df = df.withColumn("m", F.lag("gap_mean").over(o)).withColumn("d", F.lag("gap_dev").over(o)).withColumn("p", F.lag("t").over(o))
    return df.where("seq > 3 AND abs(z) < 100").select(*K, transforms.time_from_gap(F.col("p"), F.col("z"), F.col("m"), F.col("d")).alias("back"))


HOLES = """(SELECT *, coalesce(x, a.x + (b.x - a.x) * coalesce((t - a.t) / nullif(b.t - a.t, 0), 0), b.x, a.x, 0) AS filled FROM (SELECT *,
  last_value(CASE WHEN x IS NOT NULL THEN {'t': t, 'x': x} END IGNORE NULLS) OVER (PARTITION BY series ORDER BY seq ROWS UNBOUNDED PRECEDING) AS a,
  first_value(CASE WHEN x IS NOT NULL THEN {'t': t, 'x': x} END IGNORE NULLS) OVER (PARTITION BY series ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM {src}))"""


def holes_sql(src):
    return HOLES.replace("{src}", src)


@query("fill_holes_initial", f"SELECT series, seq, round(filled, 3) AS filled FROM {holes_sql(H_SQL)}")
def _(spark, sf):
    return transforms.fill_holes(H(spark, sf)).select(*K, *r3("filled"))


@query(
    "initial_segment_normalize",
    f"SELECT series, seq, round((filled - avg(filled) OVER (PARTITION BY series)) / (stddev_pop(filled) OVER (PARTITION BY series) + 1), 3) AS y FROM {holes_sql(f'(SELECT * FROM {H_SQL} WHERE seq <= 10)')}",
)
def _(spark, sf):
    return transforms.initial_segment(H(spark, sf)).where("y is not null").select(*K, *r3("y"))


@query("data_quality", f"SELECT series, seq, round(have_mean, 3) AS quality FROM {decayed_sql('CASE WHEN x IS NULL THEN 0 ELSE 1 END', D, H_SQL, 'have')}")
def _(spark, sf):
    return transforms.data_quality(H(spark, sf), D).select(*K, *r3("quality"))


USUAL = "CASE WHEN d > 0 AND d < m / 2 THEN m - d * d / (2 * m) ELSE m END"
COUNT_SQL = f"(SELECT series, seq, t, x, gap, coalesce(CASE WHEN gap / nullif(greatest(u, 0), 0) >= 1.5 THEN ceil(gap / u)::INTEGER - 1 ELSE 0 END, 0) AS n FROM (SELECT *, {USUAL} AS u FROM {GAPS_SQL}))"


@query("gap_impute_count", f"SELECT series, seq, n::BIGINT AS n_missing FROM {COUNT_SQL}")
def _(spark, sf):
    return gaps.gap_counts(E(spark, sf), D).select(*K, F.col("n_missing").cast("long").alias("n_missing"))


@query("gap_fast_forward", f"SELECT series, seq, (CASE WHEN n >= 6 THEN 1 ELSE n END)::BIGINT AS n_missing, n >= 6 AS forwarded FROM {COUNT_SQL}")
def _(spark, sf):
    return gaps.fast_forward(gaps.gap_counts(E(spark, sf), D), 2).select(*K, F.col("n_missing").cast("long").alias("n_missing"), "forwarded")


EXPLODED = f"(SELECT *, coalesce(p0, x) AS p, unnest(range(1, n + 2)) AS k FROM (SELECT *, lag(x) OVER (PARTITION BY series ORDER BY seq) AS p0 FROM {COUNT_SQL}))"
FILL_SQL = {"ZERO": "0", "FIXED_VALUES": "7.5", "PREVIOUS": "p", "NEXT": "x", "LINEAR": "p + (x - p) * k / (n + 1)"}
for _name, _v in FILL_SQL.items():

    def _fill(spark, sf, name=_name):
        return gaps.fill_gaps(gaps.gap_counts(E(spark, sf), D), name, 7.5).select(*K, F.col("k").cast("long").alias("k"), F.round("x", 7).alias("x"), "imputed")

    query(f"fill_{_name.lower().split('_')[0]}", f"SELECT series, seq, k::BIGINT AS k, round(CASE WHEN k <= n THEN {_v} ELSE x END, 7) AS x, k <= n AS imputed FROM {EXPLODED}")(_fill)


@query("fill_within_previous", f"SELECT series, seq, coalesce(x, last_value(x IGNORE NULLS) OVER (PARTITION BY series ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled FROM {H_SQL}")
def _(spark, sf):
    return gaps.fill_within(H(spark, sf)).select(*K, "filled")


@query("fill_within_fixed", f"SELECT series, seq, coalesce(x, 1.5) AS filled FROM {H_SQL}")
def _(spark, sf):
    return gaps.fill_within(H(spark, sf), 1.5).select(*K, "filled")


@query(
    "impute_admission",
    f"SELECT series, seq, k::BIGINT AS k, count(*) OVER o = 4 AND sum(CASE WHEN k <= n THEN 1 ELSE 0 END) OVER o / 4 < 0.5 AS admitted FROM {EXPLODED} WINDOW o AS (PARTITION BY series ORDER BY seq, k ROWS 3 PRECEDING)",
)
def _(spark, sf):
    return gaps.admits(gaps.fill_gaps(gaps.gap_counts(E(spark, sf), D), "ZERO"), 4).select(*K, F.col("k").cast("long").alias("k"), "admitted")


# scores: the event value brought near 1
S_SQL = f"(SELECT series, seq, t, x, 0.5 + abs(x - avg(x) OVER ()) / (1 + stddev_pop(x) OVER ()) AS score FROM {E_SQL})"


def S(spark, sf):
    df = E(spark, sf)
    a = df.agg(F.avg("x"), F.stddev_pop("x")).first()
    return df.withColumn("score", 0.5 + F.abs(F.col("x") - a[0]) / (1 + a[1]))


PRIMARY = f"(SELECT *, seq - 1 AS n, lag(p_mean) OVER o AS m, lag(p_dev) OVER o AS d FROM {decayed_sql('score', D, S_SQL, 'p')} WINDOW o AS (PARTITION BY series ORDER BY seq))"


@query(
    "primary_threshold_grade",
    f"""SELECT series, seq, round(th, 3) AS threshold, round(CASE WHEN n >= 10 AND score > 0 AND th > 0 AND score > th THEN CASE WHEN d > 0 THEN greatest(0, (least(6, (score - m) / d) - 3) / 3) WHEN score > m + 1e-10 THEN 1 ELSE 0 END ELSE 0 END, 3) AS grade
  FROM (SELECT *, CASE WHEN n >= 10 AND score > 0 THEN m + 3 * d ELSE 0 END AS th FROM {PRIMARY})""",
)
def _(spark, sf):
    return thresholds.primary_grades(S(spark, sf), D).select(*K, *r3("threshold", "grade"))


def _adaptive(shingle):
    s = f"(SELECT series, seq, score, least(score, 2) AS s, least(score, 2) - coalesce(lag(least(score, 2)) OVER (PARTITION BY series ORDER BY seq), 0) AS st FROM {S_SQL})"
    two = decayed_sql("st", D, decayed_sql("s", D, s, "p"), "q")
    fell = f"(SELECT *, CASE WHEN coalesce(lag(p_mean) OVER (PARTITION BY series ORDER BY seq), 0) > s THEN coalesce(lag(p_mean) OVER (PARTITION BY series ORDER BY seq), 0) - s END AS below FROM {two})"
    falls = decayed_sql("below", D / 2, f"(SELECT series, seq, below FROM {fell} WHERE below IS NOT NULL)", "b")
    joined = f"(SELECT f.*, last_value(g.b_dev IGNORE NULLS) OVER (PARTITION BY f.series ORDER BY f.seq ROWS UNBOUNDED PRECEDING) AS b_dev FROM {fell} f LEFT JOIN {falls} g ON f.series = g.series AND f.seq = g.seq)"
    before = f"(SELECT series, seq, score, seq - 1 AS n, {lagged('p_mean', 0)} AS m, {lagged('p_dev', 0)} AS d, {lagged('q_dev', 0)} AS q, {lagged('b_dev', 0)} AS b FROM {joined})"
    long = "least(sqrt(2) * b, d)" if shingle == 1 else "0.5 * least(d, greatest(q, sqrt(2) * b)) + 0.5 * q"
    a = f"(SELECT *, CASE WHEN n < 10 THEN 0 WHEN n > 20 THEN 1 ELSE (n - 10) / 10 END AS f, greatest(CASE WHEN m < 0.9 THEN m * 3 / 0.9 ELSE 3 END, 2) AS z, {long} AS l FROM {before})"
    b = f"(SELECT *, (z - 1) * l + d AS dd, CASE WHEN f >= 1 AND m < 0.9 THEN m * 0.8 / 0.9 ELSE 0.8 END AS ab FROM {a})"
    c = f"(SELECT *, CASE WHEN n < 10 THEN greatest(1.5, ab) ELSE greatest(ab, f * (m + dd) + (1 - f) * 1.5) END AS th FROM {b})"
    g = f"""(SELECT *, CASE WHEN score < th OR th <= 0 THEN 0 ELSE least(1, floor(20 * CASE WHEN n >= 10 THEN greatest(0, CASE WHEN dd > 0 THEN least(z, (score - th) / (dd / z)) / z ELSE 2 END)
      ELSE least(1, greatest(0, (score - 0.8) / 0.8)) END + 1e-9) / 16) END AS grade FROM {c})"""
    return f"SELECT series, seq, round(CASE WHEN score >= th AND grade = 0 THEN score ELSE th END, 3) AS threshold, round(grade, 3) AS grade FROM {g}"


for _k in (1, 4):
    query(f"adaptive_threshold_grade_{_k}", _adaptive(_k))(lambda spark, sf, k=_k: thresholds.adaptive_grades(S(spark, sf), D, shingle=k).select(*K, *r3("threshold", "grade")))


@query(
    "data_confidence",
    f"""SELECT series, seq, round(CASE WHEN 0.05 * seq >= 20 THEN least(1, q) ELSE q * (exp(0.05 * seq) - exp(0.05 * least(seq, 25))) / (exp(0.05 * seq) - 1) END, 6) AS confidence
  FROM (SELECT series, seq, have_mean AS q FROM {decayed_sql('CASE WHEN x IS NULL THEN 0 ELSE 1 END', D, H_SQL, 'have')})""",
)
def _(spark, sf):
    df = transforms.data_quality(H(spark, sf), D)
    return df.select(*K, F.round(thresholds.data_confidence(F.col("seq"), 0.05, 25, F.col("quality")), 6).alias("confidence"))


@query("alert_filter", f"SELECT series, seq, grade FROM ({_adaptive(1)}) WHERE grade > 0")
def _(spark, sf):
    return thresholds.adaptive_grades(S(spark, sf), D).select(*K, *r3("grade")).where("grade > 0")


@query("trigger_residual", f"SELECT series, seq, score * 0.6 > 0.3 * l AND score * 0.6 * 1.5 > 1.2 * 0.9 AS triggers FROM (SELECT *, lag(score) OVER (PARTITION BY series ORDER BY seq) AS l FROM {S_SQL}) WHERE seq > 1")
def _(spark, sf):
    from pyspark.sql import Window

    df = S(spark, sf).withColumn("l", F.lag("score").over(Window.partitionBy("series").orderBy("seq")))
    return df.where("seq > 1").select(*K, thresholds.triggers(F.col("score") * 0.6, F.col("l"), F.lit(1.5), F.lit(0.9)).alias("triggers"))


@query("within_noise", f"SELECT series, seq, abs(diff) <= greatest(change_dev * 1.5, 2.0, 0.1 * abs(x)) AS noise FROM {decayed_sql('diff', D, DIFF_SQL, 'change')}")
def _(spark, sf):
    df = transforms.running_statistics(E(spark, sf), D, ["series"], "seq")
    return df.select(*K, thresholds.within_noise(F.col("diff"), F.col("change_dev"), 1.5, 2.0, 0.1, F.col("x")).alias("noise"))


# a last-value forecaster, three steps ahead, with an interval of +-20
FC_SQL = f"(SELECT series, seq, h, x AS value, x - 20 AS lower, x + 20 AS upper FROM {E_SQL}, (SELECT unnest([1, 2, 3]) AS h))"
_both = f"(SELECT f.*, a.x AS actual, a.x - f.value AS error, CASE WHEN a.x BETWEEN lower AND upper THEN 1 ELSE 0 END AS ins FROM {FC_SQL} f JOIN {E_SQL} a ON a.series = f.series AND a.seq = f.seq + f.h)"
_kw = dict(keys="series, h")
ERR_SQL = decayed_sql("least(error, 0) * least(error, 0)", 0.1, decayed_sql("greatest(error, 0) * greatest(error, 0)", 0.1, decayed_sql("error", 0.1, decayed_sql("ins", 0.1, _both, "i", **_kw), "m", **_kw), "u", **_kw), "l", **_kw)
ERR_SQL = f"(SELECT series, h, seq, value, lower, upper, actual, error, i_mean AS precision, m_mean AS error_mean, sqrt(u_mean) AS error_high, -sqrt(l_mean) AS error_low FROM {ERR_SQL})"


def errors(spark, sf):
    e = E(spark, sf)
    f = e.select(*K, F.explode(F.sequence(F.lit(1), F.lit(3))).alias("h"), F.col("x").alias("value"), (F.col("x") - 20).alias("lower"), (F.col("x") + 20).alias("upper"))
    return thresholds.forecast_errors(f, e, 10).withColumn("h", F.col("h").cast("long"))


HK = ["series", "seq", "h"]
HS = "series, seq, h::BIGINT AS h"


@query("forecast_interval_precision", f"SELECT {HS}, round(precision, 3) AS precision, round(error_mean, 3) AS error_mean FROM {ERR_SQL}")
def _(spark, sf):
    return errors(spark, sf).select(*HK, *r3("precision", "error_mean"))


@query("forecast_rmse", f"SELECT {HS}, round(error_high, 3) AS error_high, round(error_low, 3) AS error_low FROM {ERR_SQL}")
def _(spark, sf):
    return errors(spark, sf).select(*HK, *r3("error_high", "error_low"))


def _calibrate(method, moved):
    w = "CASE WHEN precision < 0.9 THEN greatest(1, 1 / (precision + 0.1)) ELSE 1 END"
    sql = f"""SELECT {HS}, round(greatest(least(v, 200), 0), 3) AS value, round(greatest(least(greatest(upper, v + error_mean + 1.3 * error_high * w), 200), 0), 3) AS upper,
  round(greatest(least(least(lower, v + error_mean + 1.3 * error_low * w), 200), 0), 3) AS lower FROM (SELECT *, {moved} AS v, {w} AS w FROM {ERR_SQL})"""
    query(f"calibrate_{method.lower()}", sql)(lambda spark, sf: thresholds.calibrated(errors(spark, sf), method, low=0.0, high=200.0).select(*HK, *r3("value", "upper", "lower")))


_calibrate("SIMPLE", "value + error_mean")
_calibrate("MINIMAL", "value")


@query(
    "error_quantiles",
    f"""SELECT series, seq, round(quantile_cont(x, 0.1) OVER o, 3) AS low, round(quantile_cont(x, 0.5) OVER o, 3) AS mid, round(quantile_cont(x, 0.9) OVER o, 3) AS high
  FROM {E_SQL} WINDOW o AS (PARTITION BY series ORDER BY seq ROWS 7 PRECEDING)""",
)
def _(spark, sf):
    return summary.windowed_quantiles(E(spark, sf), "x", 8, 0.9, ["series"], "seq").select(*K, *r3("low", "mid", "high"))


@query(
    "contribution_block",
    f"""SELECT series, seq, (CASE WHEN b0 >= b1 AND b0 >= b2 THEN 0 WHEN b1 >= b2 THEN 1 ELSE 2 END)::INTEGER AS block FROM (
  SELECT series, seq, s0 + 2 * s1 AS b0, s1 + s0 + s2 AS b1, 3 * s3 AS b2 FROM (SELECT series, seq, {LAGS} FROM {E_SQL} WINDOW o AS (PARTITION BY series ORDER BY seq)) WHERE seq >= 4)""",
)
def _(spark, sf):
    """Three blocks of two coordinates: high (s0, s1, s1, s2, s3, s3), low (0, s1, s0, 0, 0, s3); sums are added in the SQL's order."""
    s = [F.col("shingle")[i] for i in range(4)]
    zero = F.lit(0.0)
    df = framing.shingle(E(spark, sf), 4)
    return df.select(*K, thresholds.contribution_block(F.array(s[0], s[1], s[1], s[2], s[3], s[3]), F.array(zero, s[1], s[0], zero, zero, s[3]), 2).alias("block"))
