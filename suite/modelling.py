"""Queries for scaling, baselines, rollout statistics and attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite.base import INTERNAL, K, comparable, cte, flows, grid_of, q, table
from suite.detection import scored
from tidewatch.functions import normal
from tidewatch.operators import models, scaling, state, targets
from tidewatch.operators.models import LinearModel

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = lambda spark, sf: comparable(fn(spark, sf))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


#: inputs: a heavy-tailed, two ordinary, a signed and a constant column
_X = ("bytes_total", "n_flows", "uniq_dst_port", "byte_asymmetry", "svc_rdp_rate")
cte("xs", "select split, w, coalesce(bytes_total, 0) * coalesce(bytes_total, 0) / 1000000.0 as bytes_total, coalesce(n_flows, 0) * 1.0 as n_flows, "
          "coalesce(uniq_dst_port, 0) * 1.0 as uniq_dst_port, coalesce((outbound_bytes - inbound_bytes) / (outbound_bytes + inbound_bytes + 1.0), 0) as byte_asymmetry, "
          "0.0::double as svc_rdp_rate, stage, y_within_K, y_attack_within_K from tgt left join vol using (split, w)")


def inputs(spark, sf):
    rows = flows(spark, sf)
    g = grid_of(rows)
    vol = g.fill(state.volume_features(rows, g, INTERNAL).select("split", "w", "bytes_total", "n_flows", "byte_asymmetry", "svc_rdp_rate"),
                 ["bytes_total", "n_flows", "byte_asymmetry", "svc_rdp_rate"], keep_ts=False)
    spread = state.spread_features(rows, g).select("split", "w", "uniq_dst_port")
    staged = targets.with_targets(state.window_stages(rows, g), K).select("split", "w", "stage", "y_within_K", "y_attack_within_K", "attack_now")
    out = staged.join(vol, ["split", "w"]).join(spread, ["split", "w"], "left").fillna(0, ["uniq_dst_port"])
    return out.withColumns({"bytes_total": F.col("bytes_total") * F.col("bytes_total") / 1000000.0, "n_flows": F.col("n_flows").cast("double"),
                            "uniq_dst_port": F.col("uniq_dst_port").cast("double")})


def _fit_sql(c):
    skew = f"skewness({c}) filter (where true)"
    return (f"select '{c}' as name, min({c}) >= 0 and coalesce({skew}, 0) > 2 as logged from xs")


cte("fit", " union all ".join(_fit_sql(c) for c in _X))
cte("xl", "select split, w, " + ", ".join(f"case when (select logged from fit where name = '{c}') then ln(1 + greatest({c}, 0)) else {c} end as {c}" for c in _X) + " from xs")


@query("scaler_fit", table(q("select name, logged, m as mean, case when s < 1e-6 then 1 else s end as std from fit join (" + " union all ".join(
    f"select '{c}' as name, avg({c}) as m, stddev_pop({c}) as s from xl" for c in _X) + ") using (name)"), s="name", i="logged", d="mean std"))
def scaler_fit(spark, sf):
    """Fitted parameters (DuckDB's skewness is the bias-corrected one)."""
    s = scaling.fit(inputs(spark, sf), list(_X))
    return spark.createDataFrame([(c, bool(u), float(m), float(d)) for c, u, m, d in zip(s.columns, s.logged, s.mean, s.std)],
                                 "name string, logged boolean, mean double, std double")


_SCALED = "select split, w, " + ", ".join(
    f"({c} - (select avg({c}) from xl)) / (select case when stddev_pop({c}) < 1e-6 then 1 else stddev_pop({c}) end from xl) as {c}" for c in _X) + " from xl"


@query("scaler_transform", table(q(_SCALED), s="split", i="w", d=" ".join(_X)))
def scaler_transform(spark, sf):
    x = inputs(spark, sf)
    return scaling.transform(x, scaling.fit(x, list(_X))).select("split", "w", *_X)


@query("scaler_inverse", table(q("select split, w, " + ", ".join(_X) + " from xs"), s="split", i="w", d=" ".join(_X)))
def scaler_inverse(spark, sf):
    x = inputs(spark, sf)
    s = scaling.fit(x, list(_X))
    return scaling.inverse(scaling.transform(x, s), s).select("split", "w", *_X)


def _poly(v, coefficients):
    out = repr(coefficients[-1]) + "::double"
    for c in reversed(coefficients[:-1]):
        out = f"({out} * {v} + {c!r}::double)"
    return out


def _probit(p):
    """The inverse normal as oracle text (the same published approximation; unit tests pin it to the library's)."""
    r, t = f"(0.180625::double - ({p} - 0.5) * ({p} - 0.5))", f"sqrt(-ln(least({p}, 1 - {p})))"
    near, far = f"({t} - 1.6::double)", f"({t} - 5.0::double)"
    return (f"case when abs({p} - 0.5) <= 0.425 then ({p} - 0.5) * {_poly(r, normal._CENTRE_NUM)} / {_poly(r, normal._CENTRE_DEN)} "
            f"else sign({p} - 0.5) * case when {t} <= 5 then {_poly(near, normal._NEAR_NUM)} / {_poly(near, normal._NEAR_DEN)} "
            f"else {_poly(far, normal._FAR_NUM)} / {_poly(far, normal._FAR_DEN)} end end")


@query("gaussian_rank", table(q("select split, w, " + ", ".join(f"{_probit(f'p_{c}')} as {c}" for c in _X) + " from (select split, w, " + ", ".join(
    f"(rank() over (partition by split order by {c}) + (count(*) over (partition by split, {c}) - 1) / 2.0 - 0.5) / count(*) over (partition by split) as p_{c}" for c in _X) + " from xs)"),
    s="split", i="w", d=" ".join(_X)))
def gaussian_rank(spark, sf):
    x = inputs(spark, sf)
    return scaling.transform(x, scaling.fit(x, list(_X), mode="rank")).select("split", "w", *_X)


def _rolling(c):
    return (f"(select (count(*) filter (where b.{c} < a.{c}) + (count(*) filter (where b.{c} = a.{c}) + 1) / 2.0 - 0.5) / count(*) from xs b where b.split = a.split and b.w between a.w - 29 and a.w)")


@query("causal_rank", table(q("select split, w, case when w < 9 then 0 else " + _probit("p1") + " end as n_flows, case when w < 9 then 0 else " + _probit("p2") +
                              f" end as byte_asymmetry from (select split, w, {_rolling('n_flows')} as p1, {_rolling('byte_asymmetry')} as p2 from xs a)"),
                            s="split", i="w", d="n_flows byte_asymmetry"))
def causal_rank(spark, sf):
    s = scaling.Scaling(("n_flows", "byte_asymmetry"), mode="rank", rank_window=30, rank_min=10)
    return scaling.transform(inputs(spark, sf), s).select("split", "w", "n_flows", "byte_asymmetry")


@query("relative_views", table(q(
    "select split, w, n_flows, coalesce(n_flows - lag(n_flows) over o, 0) as delta, case when count(*) over f = 5 then regr_slope(n_flows, w) over f else 0 end as slope from (" + _SCALED +
    ") window o as (partition by split order by w), f as (partition by split order by w rows between 4 preceding and current row)"), s="split", i="w", d="n_flows delta slope"))
def relative_views(spark, sf):
    x = inputs(spark, sf)
    s = scaling.fit(x, ["n_flows"], mode="relative", rank_window=30)
    return scaling.transform(x, s).select("split", "w", "n_flows", F.col("`n_flows@delta`").alias("delta"), F.col("`n_flows@slope`").alias("slope"))


# ---- models ----------------------------------------------------------------------------------------------

@query("logistic_leave_one_out")
def logistic_leave_one_out(spark, sf):
    """M3: per held-out split, scaler and two logistic models fitted on the others (iterative fit: rows only)."""
    x = inputs(spark, sf)
    return models.leave_out_scores(x, {"early": ["week0", "week1"], "late": ["week2", "week3", "week4"]}, list(_X))


@query("logistic_coefficients")
def logistic_coefficients(spark, sf):
    """M1 + M2: one fit with a lagged state, weights by size."""
    x = inputs(spark, sf)
    fitted = scaling.fit(x, list(_X[:4]))
    model = models.fit_logistic(scaling.transform(x, fitted), list(_X[:4]), "y_within_K", lags=1)
    return model.coefficients(spark)


@query("linear_probe")
def linear_probe(spark, sf):
    """Five-fold probe of pre-onset windows (iterative fit: rows only)."""
    x = inputs(spark, sf)
    return models.probe_auc(scaling.transform(x, scaling.fit(x, list(_X[:4]))), list(_X[:4]), "y_attack_within_K")


_SX = {"score": 1, "score2": 1}
cte("df1", "select split, w, score - lag(score) over (partition by split order by w) as d1, score2 - lag(score2) over (partition by split order by w) as d2 from sc")
cte("nll0", "select df1.split, df1.w, 0.25 * (ln(2 * pi() * s1 * s1) + d1 * d1 / (s1 * s1) + ln(2 * pi() * s2 * s2) + d2 * d2 / (s2 * s2)) as nll from df1, "
            "(select greatest(stddev_pop(d1), 1e-3) as s1, greatest(stddev_pop(d2), 1e-3) as s2 from df1) where d1 is not null")


@query("persistence_nll", table(q("select split, avg(nll) as mean, median(nll) as median, quantile_cont(nll, 0.95) as p95 from nll0 group by split"), s="split", d="mean median p95"))
def persistence_nll(spark, sf):
    s = scored(spark, sf)
    return models.nll_summary(models.persistence_nll(s, models.persistence_sigma(s, list(_SX))))


@query("persistence_error", table(q("select a.split, k, avg((pow(b.score - a.score, 2) + pow(b.score2 - a.score2, 2)) / 2) as persistence_mse from sc a join wn using (split) cross join range(1, 11) r(k) "
                                    "join sc b on b.split = a.split and b.w = a.w + k where a.w % 8 = 0 and a.w < wn.n - 11 group by a.split, k"), s="split", i="k", d="persistence_mse"))
def persistence_error(spark, sf):
    return models.persistence_error(scored(spark, sf), list(_SX), K)


@query("rollout_gain", table(q("select split, avg(p - p / (k + 1)) as rollout_gain from (select a.split, k, avg((pow(b.score - a.score, 2) + pow(b.score2 - a.score2, 2)) / 2) as p from sc a join wn using (split) cross join range(1, 11) r(k) "
                               "join sc b on b.split = a.split and b.w = a.w + k where a.w % 8 = 0 and a.w < wn.n - 11 group by a.split, k) where k >= 2 group by split"), s="split", d="rollout_gain"))
def rollout_gain(spark, sf):
    from tidewatch.operators import metrics
    curves = persistence_error(spark, sf)
    return metrics.rollout_gain(curves.withColumn("model_mse", F.col("persistence_mse") / (F.col("k") + 1)))


@query("surprise", table(q("select split, w, 0.25 * (0.1 + pow(ps - score, 2) / exp(0.1) - 0.3 + pow(ps2 - score2, 2) / exp(-0.3)) as surprise from "
                           "(select *, lag(score) over (partition by split order by w) as ps, lag(score2) over (partition by split order by w) as ps2 from sc) where ps is not null"),
                         s="split", i="w", d="surprise"))
def surprise(spark, sf):
    from tidewatch.operators.series import along
    s = scored(spark, sf)
    guess = s.select("split", "w", *(F.lag(c).over(along()).alias(c) for c in _SX)).where(F.col("score").isNotNull())
    return models.surprise(s, guess, {"score": 0.1, "score2": -0.3})


# ---- rollouts: four samples of five steps per window, from the window's own score -------------------------

cte("roll", "select split, w, 'comp' as channel, s as sample, k, least(score * (k + s) / 6.1, 1.0) as p from sc cross join range(4) a(s) cross join range(1, 6) b(k)")
cte("rcum", "select *, case when min(1 - p) over (partition by split, w, sample order by k) <= 0 then 1 else 1 - exp(sum(ln(greatest(1 - p, 1e-300))) over (partition by split, w, sample order by k)) end as u from roll")
cte("rcurve", "select *, p_cum - coalesce(lag(p_cum) over (partition by split, w order by k), 0) as p_step, max(p_raw) over (partition by split, w) as p_max from "
              "(select split, w, channel, k, avg(p) as p_raw, avg(u) as p_cum, quantile_cont(u, 0.05) as p_lo, quantile_cont(u, 0.95) as p_hi from rcum group by split, w, channel, k)")


def _rollout(spark, sf):
    rows = scored(spark, sf).select("split", "w", "score", F.lit("comp").alias("channel"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("sample"))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(5))))
    return rows.withColumn("p", F.least(F.col("score") * (F.col("k") + F.col("sample")) / 6.1, F.lit(1.0))).drop("score")


@query("rollout_curves", table(q("select * from rcurve"), s="split channel", i="w k", d="p_raw p_cum p_lo p_hi p_step p_max"))
def rollout_curves(spark, sf):
    return models.rollout_curves(_rollout(spark, sf))


@query("alarm_statistics", table(q("select split, w, channel, rule, score from (select split, w, channel, max(p_cum) filter (where k = 5) as cumulative_union, max(p_raw) as max_over_horizon, avg(p_raw) as mean_over_horizon, "
                                   "max(p_raw) filter (where k = 1) as \"step_1\", max(p_raw) filter (where k = 5) as \"step_K\" from rcurve group by split, w, channel) unpivot (score for rule in (cumulative_union, max_over_horizon, mean_over_horizon, \"step_1\", \"step_K\"))"),
                                 s="split channel rule", i="w", d="score"))
def alarm_statistics(spark, sf):
    return models.alarm_statistics(models.rollout_curves(_rollout(spark, sf)))


@query("ensemble_mean", table(q("select split, w, 'comp' as channel, (score + score2) / 2 as score from sc"), s="split channel", i="w", d="score"))
def ensemble_mean(spark, sf):
    s = scored(spark, sf)
    members = s.select("split", "w", F.lit("a").alias("run"), F.lit("comp").alias("channel"), "score").unionByName(
        s.select("split", "w", F.lit("b").alias("run"), F.lit("comp").alias("channel"), F.col("score2").alias("score")))
    return models.ensemble_mean(members, 2)


# ---- attribution over a fixed linear model ---------------------------------------------------------------

# whole-number inputs and weights that are sums of powers of two, so equal margins are equal in both engines
_MODEL = LinearModel(("score", "score2", "eligible_n"), (0.01171875, -0.0078125, 0.5), -0.5)
_Z = "(-0.5::double + 0.01171875::double * score - 0.0078125::double * score2 + 0.5::double * e)"
cte("lm", f"select *, {_Z} as z from (select split, w, y, round(score * 400) as score, round(score2 * 400) as score2, case when eligible then 1.0::double else 0.0::double end as e from sc)")
_FAC = "case when abs(z + 0.5) < 1e-12 then (1 / (1 + exp(0.5))) * (1 - 1 / (1 + exp(0.5))) else (1 / (1 + exp(-z)) - 1 / (1 + exp(0.5))) / (z + 0.5) end"
cte("attr", " union all ".join(f"select split, w, '{n}' as feature, {c} as value, {w}::double * {c} * {_FAC} as attribution from lm"
                               for n, c, w in (("score", "score", 0.01171875), ("score2", "score2", -0.0078125), ("eligible_n", "e", 0.5))))


def _lin(spark, sf):
    return scored(spark, sf).withColumns({
        "eligible_n": F.col("eligible").cast("double"), "score": F.round(F.col("score") * 400), "score2": F.round(F.col("score2") * 400)})


@query("attribution", table(q("select * from attr"), s="split feature", i="w", d="value attribution"))
def attribution(spark, sf):
    return models.attribution(_lin(spark, sf), _MODEL)


@query("top_features", table(q("select * from (select *, case when attribution >= 0 then 'up' else 'down' end as direction, row_number() over (partition by split, w order by abs(attribution) desc, feature) as rank from attr) where rank <= 2"),
                             s="split feature direction", i="w rank", d="value attribution"))
def top_features(spark, sf):
    return models.top_features(models.attribution(_lin(spark, sf), _MODEL), 2)


@query("global_attribution", table(q("select feature, avg(abs(attribution)) as mean_abs_attribution from attr group by feature"), s="feature", d="mean_abs_attribution"))
def global_attribution(spark, sf):
    return models.global_attribution(models.attribution(_lin(spark, sf), _MODEL))


@query("windows_to_explain", table(q("select split, w from (select *, row_number() over (partition by split, alarm order by score desc, w) as r from al) where (alarm and r <= 24) or w % 8 = 0"), s="split", i="w"))
def windows_to_explain(spark, sf):
    from suite.detection import alarmed
    return models.windows_to_explain(alarmed(spark, sf)).select("split", "w")


_CASES = {"": "z", "*flagged*": "z - 0.01171875::double * score + 0.0078125::double * score2", "score": "z - 0.01171875::double * score",
          "score2": "z + 0.0078125::double * score2", "eligible_n": "z - 0.5::double * e"}
cte("rel0", " union all ".join(f"select split, '{n}' as feature, y, {v} as s from lm" for n, v in _CASES.items()))
cte("rel1", "select split, feature, case when p > 0 and n > 0 then (rs - p * (p + 1) / 2) / (p * n) end as roc_auc from (select split, feature, sum(y) as p, count(*) - sum(y) as n, sum(r * y) as rs from "
            "(select *, rank() over (partition by split, feature order by s) + (count(*) over (partition by split, feature, s) - 1) / 2.0 as r from rel0) group by split, feature)")


@query("reliance", table(q("select a.split, a.feature, a.roc_auc, a.roc_auc - b.roc_auc as delta from rel1 a join rel1 b on b.split = a.split and b.feature = '' where a.feature <> ''"),
                         s="split feature", d="roc_auc delta"))
def reliance(spark, sf):
    return models.reliance(_lin(spark, sf), _MODEL, ["score", "score2"]).select("split", "feature", "roc_auc", "delta")
