"""Queries for thresholds, alarms, lead times and detection metrics, scored by a feature of the fixture windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite.base import INTERNAL, K, comparable, cte, flows, grid_of, q, table
from tidewatch.operators import alerts, episodes, metrics, reports, state, targets
from tidewatch.plans import scorecard as cards

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = lambda spark, sf: comparable(fn(spark, sf))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


# ---- the scored windows every query below reads ----------------------------------------------------------

cte("cnt", "select split, w, count(*) as n_flows, count(distinct dst_port) as ports, count(distinct src_ip) as srcs from ex group by split, w")
cte("sc", "select tgt.split, tgt.w, tgt.stage, y_within_K as y, y_attack_within_K as ya, attack_now, tgt.stage = 0 as eligible, sp.ts_us, "
          "(coalesce(ports, 0) * 10 + coalesce(n_flows, 0)) / 400.0 as score, (coalesce(srcs, 0) * 10 + coalesce(n_flows, 0)) / 400.0 as score2 "
          "from tgt join sp using (split, w) left join cnt using (split, w)")
_PAST = "(partition by split order by w rows between unbounded preceding and 1 preceding)"
cte("al0", f"select *, case when row_number() over (partition by split order by w) > 20 then quantile_cont(score, 0.9) over {_PAST} end as threshold from sc")
cte("al", "select *, coalesce(score >= threshold, false) as alarm from al0")


def scored(spark, sf):
    rows = flows(spark, sf)
    g = grid_of(rows)
    counts = state.spread_features(rows, g).select("split", "w", F.col("uniq_dst_port").alias("ports"), F.col("uniq_src_ip").alias("srcs"))
    n = g.to_windows(g.locate(rows.select("split", "ts")).groupBy("split", "slice_no", "n").agg(F.count("*").alias("c")))
    n = n.groupBy("split", "w").agg(F.sum("c").alias("n_flows"))
    staged = targets.with_targets(g.with_window_start(state.window_stages(rows, g)), K)
    out = staged.join(counts, ["split", "w"], "left").join(n, ["split", "w"], "left").fillna(0, ["ports", "srcs", "n_flows"])
    return out.select("split", "w", "ts", "stage", F.col("y_within_K").alias("y"), F.col("y_attack_within_K").alias("ya"), "attack_now",
                      (F.col("stage") == 0).alias("eligible"), ((F.col("ports") * 10 + F.col("n_flows")) / 400.0).alias("score"),
                      ((F.col("srcs") * 10 + F.col("n_flows")) / 400.0).alias("score2"))


def alarmed(spark, sf):
    return alerts.causal_threshold(scored(spark, sf), 0.90)


# ---- E1-E9 -----------------------------------------------------------------------------------------------

@query("causal_threshold", table(q("select * from al"), s="split", i="w alarm", d="score threshold"))
def causal_threshold(spark, sf):
    return alarmed(spark, sf).select("split", "w", "score", "threshold", "alarm")


def _trail(n):
    return (f"select split, w, score, case when row_number() over (partition by split order by w) > 20 then quantile_cont(score, 0.9) over "
            f"(partition by split order by w rows between {n} preceding and 1 preceding) end as threshold from sc")


@query("trailing_threshold", table(q(f"select *, coalesce(score >= threshold, false) as alarm from ({_trail(60)})"), s="split", i="w alarm", d="score threshold"))
def trailing_threshold(spark, sf):
    return alerts.causal_threshold(scored(spark, sf), 0.90, trailing=60).select("split", "w", "score", "threshold", "alarm")


_POL = ("select 'whole-capture-10pct' as policy, split, w, score, y, quantile_cont(score, 0.9) over (partition by split) as threshold from sc union all "
        "select 'expanding-10pct', split, w, score, y, threshold from al union all "
        + " union all ".join(f"select 'trailing{n}-10pct', split, w, score, y, threshold from ({_trail(n).replace('select split, w, score,', 'select split, w, score, y,')})" for n in (120, 60))
        + f" union all select 'expanding-5pct', split, w, score, y, case when row_number() over (partition by split order by w) > 20 then quantile_cont(score, 0.95) over {_PAST} end from sc "
        "union all select 'train-quantile-5pct', sc.split, w, score, y, t.threshold from sc join (select a.split, quantile_cont(b.score, 0.95) as threshold from "
        "(select distinct split from sc) a join sc b on a.split <> b.split group by a.split) t on t.split = sc.split")
cte("pol", _POL)
_CONF = ("count(*) filter (where a and y = 1) as tp, count(*) filter (where a and y = 0) as fp, count(*) filter (where not a and y = 1) as fn, "
         "count(*) filter (where not a and y = 0) as tn, count(*) filter (where y = 1) as positives, count(*) as n")
_RATIO = ("select *, case when tp + fp > 0 then tp / (tp + fp) else 0 end as precision, case when tp + fn > 0 then tp / (tp + fn) else 0 end as recall, "
          "case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end as f1, case when fp + tn > 0 then fp / (fp + tn) else 0 end as fpr, "
          "(tp + fp) / n as alarm_rate from ")
_CI, _CD = "tp fp fn tn positives n", "precision recall f1 fpr alarm_rate"


@query("threshold_policies", table(q(f"{_RATIO} (select policy, split, {_CONF} from (select *, coalesce(score >= threshold, false) as a from pol) group by policy, split)"),
                                   s="policy split", i=_CI, d=_CD))
def threshold_policies(spark, sf):
    """Six alert policies side by side, each scored by the confusion metrics."""
    s = scored(spark, sf).select("split", "w", "score", "y")
    return metrics.confusion(alerts.threshold_policies(s, hold_out=True), ("policy", "split"))


@query("confusion", table(q(f"{_RATIO} (select split, {_CONF} from (select *, alarm as a from al) group by split)"), s="split", i=_CI, d=_CD))
def confusion(spark, sf):
    return metrics.confusion(alarmed(spark, sf))


cte("rk", "select *, (rank() over (partition by split order by score)) + (count(*) over (partition by split, score) - 1) / 2.0 as r from sc")
cte("pr", "select split, score, sum(y) as pos, count(*) as c, sum(sum(y)) over (partition by split order by score desc) as tp, "
          "sum(count(*)) over (partition by split order by score desc) as k, sum(sum(y)) over (partition by split) as p from sc group by split, score")


@query("ranking_metrics", table(q(
    "select split, case when p > 0 and n > 0 then (rs - p * (p + 1) / 2) / (p * n) end as roc_auc, case when p > 0 and n > 0 then ap end as pr_auc from "
    "(select split, sum(y) as p, count(*) - sum(y) as n, sum(case when y = 1 then r else 0 end) as rs from rk group by split) join "
    "(select split, sum(case when p > 0 then pos / p * tp / k else 0 end) as ap from pr group by split) using (split)"), s="split", d="roc_auc pr_auc"))
def ranking_metrics(spark, sf):
    return metrics.ranking_metrics(scored(spark, sf))


@query("best_threshold", table(q(
    "select split, t as threshold, f1 from (select *, row_number() over (partition by split order by f1 desc, t) as r from (select split, t, "
    "case when count(*) filter (where s.y = 1) + count(*) filter (where s.score >= t) > 0 then 2 * count(*) filter (where s.y = 1 and s.score >= t) / "
    "(count(*) filter (where s.y = 1) + count(*) filter (where s.score >= t)) else 0 end as f1 from sc s cross join (select case when i = 100 then 0.99::double else 0.01::double + i * ((0.99::double - 0.01::double) / 100) end as t "
    "from range(101) x(i)) group by split, t)) where r = 1"), s="split", d="threshold f1"))
def best_threshold(spark, sf):
    return metrics.best_threshold(scored(spark, sf))


@query("alarm_rate", table(q("select split, count(*) as windows, avg(case when alarm then 1.0 else 0.0 end) as alarm_rate from al group by split"),
                           s="split", i="windows", d="alarm_rate"))
def alarm_rate(spark, sf):
    return alerts.alarm_rate(alarmed(spark, sf))


cte("runs0", "select split, min(w) as begin_w, max(w) as end_w, count(*) as windows, max(score) as peak, min_by(threshold, w) as threshold from "
             "(select *, w - row_number() over (partition by split order by w) as g from al where alarm) group by split, g")
cte("runs", "select r.*, r.windows >= 2 as sustained, case when r.windows >= 2 then min(o.onset_w) end as onset_w from runs0 r left join ons_c o on o.split = r.split "
            "and o.onset_w between r.begin_w and r.begin_w + 10 group by r.split, r.begin_w, r.end_w, r.windows, r.peak, r.threshold")


@query("alarm_runs", table(q("select *, onset_w - begin_w as lead_windows, (onset_w - begin_w) * 1800 as lead_seconds from runs"),
                           s="split", i="begin_w end_w windows sustained onset_w lead_windows", d="peak threshold lead_seconds"))
def alarm_runs(spark, sf):
    a = alarmed(spark, sf)
    return alerts.alarm_runs(a, targets.episode_onsets(a, "compromise"), K, 1800.0)


# ---- E10-E16 ---------------------------------------------------------------------------------------------

def _lead(onsets, persistence, confirm, eligible):
    a = "(alarm and eligible)" if eligible else "alarm"
    run = " and ".join([a] + [f"coalesce(lead({a}, {j}) over o, false)" for j in range(1, persistence)])
    last = persistence if confirm else 1
    return (f"select x.split, x.onset_w, x.family, min(s.w) filter (where s.start and s.w <= x.onset_w - {last}) as first_alarm, "
            f"count(s.w) filter (where s.eligible) as eligible_windows, any_value(x.score) as score_at_onset from "
            f"(select o.*, al.score from {onsets} o join al on al.split = o.split and al.w = o.onset_w) x left join "
            f"(select split, w, eligible, {run} as start from al window o as (partition by split order by w)) s "
            f"on s.split = x.split and s.w >= x.onset_w - 10 and s.w < x.onset_w group by x.split, x.onset_w, x.family")


def _lead_table(inner):
    return table(q(f"select *, coalesce(onset_w - first_alarm, 0) as lead_windows, first_alarm is not null as detected_early from ({inner})"),
                 s="split family", i="onset_w first_alarm eligible_windows lead_windows detected_early", d="score_at_onset")


_LEADCOLS = ["split", "family", "onset_w", "first_alarm", "eligible_windows", "lead_windows", "detected_early", "score_at_onset"]


@query("lead_times", _lead_table(_lead("ons_a", 1, False, False)))
def lead_times(spark, sf):
    a = alarmed(spark, sf)
    return episodes.lead_times(a, targets.episode_onsets(a), K).select(*_LEADCOLS)


@query("strict_lead_times", _lead_table(_lead("ons_a", 2, True, True)))
def strict_lead_times(spark, sf):
    a = alarmed(spark, sf)
    return episodes.strict_lead_times(a, targets.episode_onsets(a), K).select(*_LEADCOLS)


cte("ld", f"select *, coalesce(onset_w - first_alarm, 0) as lead_windows from ({_lead('ons_a', 2, False, False)})")


@query("lead_summary", table(q("select split, count(*) as episodes, count(*) filter (where lead_windows > 0) as warned_early, coalesce(avg(lead_windows) filter (where lead_windows > 0), 0) "
                               "as mean_lead_windows, coalesce(avg(lead_windows) filter (where lead_windows > 0), 0) * 1800 as mean_lead_seconds, max(lead_windows) as max_lead_windows from ld group by split"),
                             s="split", i="episodes warned_early max_lead_windows", d="mean_lead_windows mean_lead_seconds"))
def lead_summary(spark, sf):
    a = alarmed(spark, sf)
    return episodes.lead_summary(episodes.lead_times(a, targets.episode_onsets(a), K, persistence=2), 1800.0)


def _shift():
    return F.col("min_shift") + F.pmod(F.col("i").cast("bigint") * 7919, F.col("n") - 2 * F.col("min_shift"))

cte("wn", "select split, count(*) as n from al group by split")
cte("rolled", "select a.split, i, b.w, a.alarm and b.eligible as hit from (select split, n, i, 10 + (i * 7919) % (n - 20) as s from wn cross join range(40) x(i) where n > 20) k "
              "join al b on b.split = k.split join al a on a.split = k.split and a.w = (b.w - k.s + k.n) % k.n")
cte("rstart", "select *, hit and coalesce(lead(hit) over (partition by split, i order by w), false) as start from rolled")
cte("ostart", "select split, w, alarm and eligible and coalesce(lead(alarm and eligible) over (partition by split order by w), false) as start from al")
cte("ocount", "select w.split, count(distinct o.onset_w) filter (where s.start) as observed from wn w left join ons_a o using (split) left join ostart s on s.split = o.split and s.w between o.onset_w - 10 and o.onset_w - 2 group by w.split")
cte("rcount", "select r.split, r.i, count(distinct o.onset_w) filter (where r.start) as c from rstart r left join ons_a o on o.split = r.split and r.w between o.onset_w - 10 and o.onset_w - 2 group by r.split, r.i")


@query("circular_shift_null", table(q(
    "select o.split, observed, count(c) as n_shifts, avg(c) as null_mean, floor(quantile_cont(c, 0.95)) as null_p95, max(c) as null_max, (1 + count(*) filter (where c >= observed)) / (1.0 + count(c)) as p_value, "
    "observed > floor(quantile_cont(c, 0.95)) as exceeds_p95 from ocount o join rcount r using (split) where exists (select 1 from ons_a x where x.split = o.split) group by o.split, observed"),
    s="split", i="observed n_shifts null_p95 null_max exceeds_p95", d="null_mean p_value"))
def circular_shift_null(spark, sf):
    a = alarmed(spark, sf)
    return episodes.circular_shift_null(a, targets.episode_onsets(a), K, 2, 40, shift=_shift())


@query("fisher_combine", table(q(
    "select chi2, df, exp(-chi2 / 2) * (select sum(pow(chi2 / 2, i) / gamma(i + 1)) from range(1000) x(i) where i < df / 2) as p_combined from (select -2 * sum(ln(p)) as chi2, 2 * count(*) as df from ("
    "select greatest(avg(y) + 0.001, 1e-12) as p from sc group by split))"), i="df", d="chi2 p_combined"))
def fisher_combine(spark, sf):
    p = scored(spark, sf).groupBy("split").agg((F.avg("y") + 0.001).alias("p_value"))
    return episodes.fisher_combine(p)


cte("nearon", "select distinct sc.split, sc.w from sc join ons_a o on o.split = sc.split and abs(sc.w - o.onset_w) < 20")
cte("refw", "select sc.split, sc.w, score from sc left join nearon using (split, w) where nearon.w is null and eligible")


@query("lead_bin_percentiles", table(q(
    "select o.split, o.onset_w, k as lead_offset, case when k <= 4 then '0-2min' when k <= 8 then '2-4min' when k <= 12 then '4-6min' else '6-10min' end as bin, "
    "(count(*) filter (where r.score < s.score) + 0.5 * count(*) filter (where r.score = s.score)) / count(*) as percentile from ons_a o cross join range(1, 21) x(k) "
    "join sc s on s.split = o.split and s.w = o.onset_w - k and s.eligible join refw r on r.split = o.split where o.family <> 'IMPACT' group by o.split, o.onset_w, k, s.score"),
    s="split bin", i="onset_w lead_offset", d="percentile"))
def lead_bin_percentiles(spark, sf):
    s = scored(spark, sf)
    onset = targets.episode_onsets(s)
    return episodes.lead_bin_percentiles(s, targets.without_family(onset, "IMPACT"), onset).withColumnRenamed("offset", "lead_offset")


@query("family_breakdown", table(q("select family, count(*) filter (where lead_windows > 0) as warned, count(*) as episodes from ld group by family"), s="family", i="warned episodes"))
def family_breakdown(spark, sf):
    a = alarmed(spark, sf)
    return episodes.family_breakdown(episodes.lead_times(a, targets.episode_onsets(a), K, persistence=2))


@query("per_onset_rows", table(q("select ld.split, ld.onset_w, ld.family, quiet_windows, lead_windows from ld join quiet using (split, onset_w)"), s="split family", i="onset_w quiet_windows lead_windows"))
def per_onset_rows(spark, sf):
    a = alarmed(spark, sf)
    leads = episodes.lead_times(a, targets.episode_onsets(a), K, persistence=2)
    return targets.quiet_before(a, leads).select("split", "onset_w", "family", "quiet_windows", "lead_windows")


@query("scorecard")
def scorecard(spark, sf):
    """The whole scorecard over two channels (composition; each part has its own oracle)."""
    s = scored(spark, sf).withColumnRenamed("y", "y_within_K").withColumnRenamed("ya", "y_attack_within_K")
    scores = s.select("split", "w", F.lit("r1").alias("run"), F.lit(42).alias("seed"), F.lit("comp").alias("channel"), "score").unionByName(
        s.select("split", "w", F.lit("r1").alias("run"), F.lit(42).alias("seed"), F.lit("threat").alias("channel"), F.col("score2").alias("score")))
    return cards.scorecard(scores, s, horizon=K, n_shifts=40)


# ---- E17-E35 ---------------------------------------------------------------------------------------------

cte("sd", "select 40 + w % 3 as seed, split, sum(score) / count(*) as s2_star, avg(score2) as s1_precision, avg(y) as s1_fpr, max(score) as pr_auc from sc group by 1, 2")


def _seeded(spark, sf):
    return scored(spark, sf).groupBy((F.col("w") % 3 + 40).alias("seed"), "split").agg(
        F.avg("score").alias("s2_star"), F.avg("score2").alias("s1_precision"), F.avg("y").alias("s1_fpr"), F.max("score").alias("pr_auc"))


_M = ("s2_star", "s1_precision", "s1_fpr", "pr_auc")


@query("paired_comparison", table(q(" union all ".join(
    f"select a.split as candidate, '{m}' as metric, count(*) as seeds, avg(a.{m} - b.{m}) as mean_delta, count(*) filter (where a.{m} - b.{m} > 0) as seeds_up, min(a.{m}) as candidate_min "
    "from sd a join sd b using (seed) where a.split <> 'week0' and b.split = 'week0' group by a.split" for m in _M)), s="candidate metric", i="seeds seeds_up", d="mean_delta candidate_min"))
def paired_comparison(spark, sf):
    """Every later split against the first."""
    t = _seeded(spark, sf)
    candidates = t.where("split <> 'week0'").withColumnRenamed("split", "candidate")
    return metrics.paired_comparison(candidates, t.where("split = 'week0'"), list(_M), ("candidate",))


@query("adoption_rule", table(q(
    "select *, anticipation and alarm_cost and stability as adopted, alarm_cost and stability as non_inferior from (select a.split as candidate, avg(a.s2_star - b.s2_star) >= 0.03 and count(*) filter (where a.s2_star > b.s2_star) >= 2 as anticipation, "
    "avg(a.s1_precision - b.s1_precision) > -0.05 and avg(a.s1_fpr - b.s1_fpr) < 0.02 as alarm_cost, min(a.pr_auc) >= 0.2 as stability from sd a join sd b using (seed) where a.split <> 'week0' and b.split = 'week0' group by a.split)"),
    s="candidate", i="anticipation alarm_cost stability adopted non_inferior"))
def adoption_rule(spark, sf):
    return metrics.adoption_rule(paired_comparison(spark, sf), ("candidate",))


@query("ablation_deltas", table(q("select a.seed, a.split as arm, a.s2_star - c.s2_star as s2_star_vs_week0, c.pr_auc - a.pr_auc as pr_auc_vs_week0 from sd a join sd c on c.seed = a.seed and c.split = 'week0'"),
                                s="arm", i="seed", d="s2_star_vs_week0 pr_auc_vs_week0"))
def ablation_deltas(spark, sf):
    t = _seeded(spark, sf).withColumnRenamed("split", "arm").withColumn("fold", F.lit("f"))
    return metrics.ablation_deltas(t, "week0", {"s2_star": True, "pr_auc": False}).select("seed", "arm", "s2_star_vs_week0", "pr_auc_vs_week0")


@query("seed_summary", table(q("select split, avg(s2_star) as s2_star_mean, min(s2_star) as s2_star_min, max(s2_star) as s2_star_max, avg(pr_auc) as pr_auc_mean, min(pr_auc) as pr_auc_min, max(pr_auc) as pr_auc_max from sd group by split"),
                             s="split", d="s2_star_mean s2_star_min s2_star_max pr_auc_mean pr_auc_min pr_auc_max"))
def seed_summary(spark, sf):
    return metrics.seed_summary(_seeded(spark, sf), ("split",), ["s2_star", "pr_auc"])


cte("fam", "select case when split in ('week0', 'week1') then 'A' when split = 'week2' then 'B' else 'C' end as family, split, seed, s2_star * 2.5 as roc_auc from sd")


@query("family_verdict", table(q(
    "select family, count(*) as splits, avg(roc) as roc_auc_mean, case when bool_or(low >= 2) then 'inverted' when bool_and(high >= 2) then 'transfers' else 'partial' end as verdict from (select family, split, "
    "count(*) filter (where roc_auc >= 0.7) as high, count(*) filter (where roc_auc < 0.5) as low, avg(roc_auc) as roc from fam group by family, split) group by family"),
    s="family verdict", i="splits", d="roc_auc_mean"))
def family_verdict(spark, sf):
    fam = F.when(F.col("split").isin("week0", "week1"), "A").when(F.col("split") == "week2", "B").otherwise("C")
    return metrics.family_verdict(_seeded(spark, sf).select(fam.alias("family"), "split", "seed", (F.col("s2_star") * 2.5).alias("roc_auc")))


@query("primary_target", table(q(
    "select sc.split, w, case when c.split is null then 'threat' else 'comp' end as target, case when c.split is null then score2 else score end as score, case when c.split is null then ya else y end as y "
    "from sc left join (select distinct split from ons_c) c on c.split = sc.split"), s="split target", i="w y", d="score"))
def primary_target(spark, sf):
    s = scored(spark, sf)
    scores = s.select("split", "w", F.lit("comp").alias("channel"), "score").unionByName(s.select("split", "w", F.lit("threat").alias("channel"), F.col("score2").alias("score")))
    states = s.select("split", "w", F.col("y").alias("y_within_K"), F.col("ya").alias("y_attack_within_K"))
    return metrics.primary_target(scores, states, targets.episode_onsets(s, "compromise"))


def _start():
    return F.pmod(F.col("b").cast("bigint") * 7919 + F.col("j") * 104729, F.col("n") - F.col("block") + 1)

cte("bpick", "select k.split, b, s + x as w from (select split, n, b, j, (b * 7919 + j * 104729) % (n - 20 + 1) as s from wn cross join range(30) r(b) cross join range(200) q(j) where j * 20 < n) k cross join range(20) o(x) where j * 20 + x < n")
cte("brank", "select bpick.split, b, y, rank() over (partition by bpick.split, b order by score) + (count(*) over (partition by bpick.split, b, score) - 1) / 2.0 as r, "
             "rank() over (partition by bpick.split, b order by score2) + (count(*) over (partition by bpick.split, b, score2) - 1) / 2.0 as r2 from bpick join sc on sc.split = bpick.split and sc.w = bpick.w")
cte("bauc", "select split, b, case when p > 0 and n > 0 then (s1 - p * (p + 1) / 2) / (p * n) end as a1, case when p > 0 and n > 0 then (s2 - p * (p + 1) / 2) / (p * n) end as a2 from "
            "(select split, b, sum(y) as p, count(*) - sum(y) as n, sum(r * y) as s1, sum(r2 * y) as s2 from brank group by split, b)")


def _boot(spark, sf):
    return metrics.block_bootstrap(scored(spark, sf).select("split", "w", "y", "score", "score2"), 20, 30, _start(), ("score", "score2"))


@query("block_bootstrap", table(q("select split, 'score' as series, quantile_cont(a1, 0.025) as lo, quantile_cont(a1, 0.975) as hi, count(*) filter (where a1 is null) as dropped from bauc group by split union all "
                                  "select split, 'score2', quantile_cont(a2, 0.025), quantile_cont(a2, 0.975), count(*) filter (where a2 is null) from bauc group by split"),
                                s="split series", i="dropped", d="lo hi"))
def block_bootstrap(spark, sf):
    return metrics.bootstrap_interval(_boot(spark, sf))


@query("paired_bootstrap", table(q("select split, avg(a1 - a2) as mean_difference, quantile_cont(a1 - a2, 0.025) as lo, quantile_cont(a1 - a2, 0.975) as hi from bauc group by split"),
                                 s="split", d="mean_difference lo hi"))
def paired_bootstrap(spark, sf):
    return metrics.paired_differences(_boot(spark, sf), "score", "score2")


_BINS = " + ".join(f"case when score >= {repr(i * 0.1)}::double then 1 else 0 end" for i in range(1, 10))
cte("rel", f"select split, {_BINS} as bin, count(*) as n, avg(score) as mean_p, avg(y) as observed from sc group by all")


@query("reliability", table(q("select * from rel"), s="split", i="bin n", d="mean_p observed"))
def reliability(spark, sf):
    return metrics.reliability(scored(spark, sf))


@query("calibration", table(q("select * from (select split, count(*) as n, avg(y) as base_rate, avg(score) as mean_forecast, avg((score - y) * (score - y)) as brier, var_pop(y) as brier_base_rate from sc group by split) "
                              "join (select split, sum(n * abs(mean_p - observed)) / sum(n) as ece from rel group by split) using (split)"),
                            s="split", i="n", d="base_rate mean_forecast brier brier_base_rate ece"))
def calibration(spark, sf):
    return metrics.calibration(scored(spark, sf))


@query("temperature_scaling")
def temperature_scaling(spark, sf):
    s = scored(spark, sf)
    return metrics.calibration(metrics.temperature_scaled(s, metrics.fit_temperature(s)))


cte("prd", "select split, w, stage, case when score > 0.22 then stage when score > 0.2 then 1 else 0 end as pred_stage from sc")
cte("cells", "select s.split, t.stage, p.pred_stage, coalesce(c, 0) as windows from (select distinct split from sc) s cross join (select unnest(generate_series(0, 6)) as stage) t cross join "
             "(select unnest(generate_series(0, 6)) as pred_stage) p left join (select split, stage, pred_stage, count(*) as c from prd group by all) x on x.split = s.split and x.stage = t.stage and x.pred_stage = p.pred_stage")


def _predicted(spark, sf):
    return scored(spark, sf).withColumn("pred_stage", F.when(F.col("score") > 0.22, F.col("stage")).when(F.col("score") > 0.2, 1).otherwise(0))


@query("stage_confusion", table(q("select * from cells"), s="split", i="stage pred_stage windows"))
def stage_confusion(spark, sf):
    return metrics.stage_confusion(_predicted(spark, sf))


@query("per_stage", table(q(
    "select s.split, s.stage, support, predicted, case when predicted > 0 then hits / predicted end as precision, case when support > 0 then hits / support end as recall from "
    "(select split, case when stage = 3 then 1 else stage end as stage, sum(windows) as support, sum(case when (case when stage = 3 then 1 else stage end) = (case when pred_stage = 3 then 1 else pred_stage end) then windows else 0 end) as hits from cells group by 1, 2) s join "
    "(select split, case when pred_stage = 3 then 1 else pred_stage end as stage, sum(windows) as predicted from cells group by 1, 2) p using (split, stage)"),
    s="split", i="stage support predicted", d="precision recall"))
def per_stage(spark, sf):
    """The technique view: reconnaissance and lateral movement count as one."""
    return metrics.per_stage(metrics.stage_confusion(_predicted(spark, sf)), merge_discovery=True)


@query("stage_summary", table(q(
    "select split, avg(case when stage = pred_stage then 1.0 else 0 end) as accuracy, count(*) filter (where stage > 0) as hostile_windows, avg(case when stage = pred_stage then 1.0 else 0 end) filter (where stage > 0) as hostile_stage_accuracy, "
    "avg(case when pred_stage > 0 then 1.0 else 0 end) filter (where stage > 0) as hostile_detected, avg(case when pred_stage > 0 then 1.0 else 0 end) filter (where stage = 0) as benign_false_stage from prd group by split"),
    s="split", i="hostile_windows", d="accuracy hostile_stage_accuracy hostile_detected benign_false_stage"))
def stage_summary(spark, sf):
    return metrics.stage_summary(_predicted(spark, sf))


def _effect(kind):
    var = "var_samp" if kind == "cohen" else "var_pop"
    one = []
    for f in ("score", "score2"):
        inner = (f"select split, avg({f}) filter (where y = 1) - avg({f}) filter (where y = 0) as diff, {var}({f}) filter (where y = 1) as va, {var}({f}) filter (where y = 0) as vb, "
                 f"sum(y) as na, count(*) - sum(y) as nb from sc group by split")
        if kind == "cohen":
            sd = "sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2))"
            one.append(f"select split, '{f}' as feature, case when {sd} >= 1e-9 then diff / {sd} end as d from ({inner})")
        else:
            sd = "sqrt((va + vb) / 2)"
            one.append(f"select split, '{f}' as feature, case when {sd} > 1e-9 then diff / {sd} else 0 end as d from ({inner})")
    return " union all ".join(one)


@query("effect_sizes", table(q(_effect("cohen")), s="split feature", d="d"))
def effect_sizes(spark, sf):
    return metrics.effect_sizes(scored(spark, sf), ["score", "score2"], F.col("y") == 1)


@query("effect_sizes_smd", table(q(_effect("smd")), s="split feature", d="d"))
def effect_sizes_smd(spark, sf):
    return metrics.effect_sizes(scored(spark, sf), ["score", "score2"], F.col("y") == 1, pooled="smd")


@query("top_effects", table(q(f"select * from (select split, feature, d, row_number() over (partition by split order by abs(d) desc, feature) as rank from ({_effect('cohen')}) where d is not null) where rank <= 1"),
                            s="split feature", i="rank", d="d"))
def top_effects(spark, sf):
    return metrics.top_effects(effect_sizes(spark, sf), 1)


@query("direction_flips", table(q(
    "select b.split, b.feature, a.d as d_train, b.d as d_held, coalesce(sign(a.d) <> sign(b.d) and abs(a.d) >= 0.2 and abs(b.d) >= 0.2, false) as flips from "
    f"(select * from ({_effect('smd')}) where split = 'week0') a join (select * from ({_effect('smd')}) where split <> 'week0') b on b.feature = a.feature"), s="split feature", i="flips", d="d_train d_held"))
def direction_flips(spark, sf):
    """Every later split against the first."""
    d = effect_sizes_smd(spark, sf)
    return metrics.direction_flips(d.where("split = 'week0'").drop("split"), d.where("split <> 'week0'"), keys=(), per=("split",))


@query("background_windows", table(q("select s.split, s.w, not exists (select 1 from sc t where t.split = s.split and t.attack_now = 1 and s.w >= t.w - 6 and s.w < t.w + 6) as background from sc s"),
                                   s="split", i="w background"))
def background_windows(spark, sf):
    return metrics.background_windows(scored(spark, sf), 6).select("split", "w", "background")


@query("evenly_spaced", table(q("select split, w from (select *, row_number() over (partition by split order by w) - 1 as i, count(*) over (partition by split) as n from sc where attack_now = 1) "
                                "where n <= 24 or i in (select round_even(k * (n - 1) / 23.0, 0) from range(24) x(k))"), s="split", i="w"))
def evenly_spaced(spark, sf):
    return metrics.evenly_spaced(scored(spark, sf).where("attack_now = 1").select("split", "w"), ("split",))


@query("signature_hits", table(q(
    "select episode, size, hits, (select sum(gamma(size + 1.0) / gamma(x + 1.0) / gamma(size - x + 1.0) * gamma(10.0 - size + 1) / gamma(2.0 - x + 1) / gamma(10.0 - size - 2 + x + 1)) from range(3) r(x) where x >= hits and x <= least(size, 2) and 2 - x <= 10 - size) / 45.0 as p_value "
    "from (select 'week' as episode, 1 as size, count(*) filter (where feature = 'score') as hits from (select feature from (select feature, avg(abs(d)) as m from (" + _effect("cohen") + ") group by feature) order by m desc, feature limit 1))"),
    s="episode", i="size hits", d="p_value"))
def signature_hits(spark, sf):
    from pyspark.sql import Window
    d = effect_sizes(spark, sf).groupBy("feature").agg(F.avg(F.abs("d")).alias("m"))
    ranking = d.withColumn("episode", F.lit("week")).withColumn("rank", F.row_number().over(Window.partitionBy("episode").orderBy(F.desc("m"), "feature")))
    ranking = ranking.withColumn("rank", F.when(F.col("rank") > 1, F.lit(99)).otherwise(F.col("rank")))
    signature = d.where("feature = 'score'").select(F.lit("week").alias("episode"), "feature")
    return metrics.signature_hits(ranking, signature, 10, 2)


@query("spearman", table(q("select split, corr(a, b) as spearman from (select split, rank() over (partition by split order by score) + (count(*) over (partition by split, score) - 1) / 2.0 as a, "
                           "rank() over (partition by split order by score2) + (count(*) over (partition by split, score2) - 1) / 2.0 as b from sc) group by split"), s="split", d="spearman"))
def spearman(spark, sf):
    return metrics.spearman(scored(spark, sf), "score", "score2", ("split",))


_FLOORS = ("score", "score2")


@query("single_feature_floors", table(q(
    f"{_RATIO} (select feature, budget, split, {_CONF} from (select feature, budget, split, y, v >= case budget when 10 then q10 when 5 then q5 else q2 end as a from "
    "(select *, quantile_cont(v, 0.9) over g as q10, quantile_cont(v, 0.95) over g as q5, quantile_cont(v, 0.98) over g as q2 from "
    "(select split, w, y, 'score' as feature, score as v from sc union all select split, w, y, 'score2', score2 from sc) window g as (partition by feature, split)) "
    "cross join (values (10), (5), (2)) b(budget)) group by feature, budget, split)"),
    s="feature split", i="budget " + _CI, d=_CD))
def single_feature_floors(spark, sf):
    """Raw columns as alarms at 10, 5 and 2 % budgets, through the same metrics."""
    return cards.feature_floors(scored(spark, sf), list(_FLOORS))


@query("score_distribution", table(q("select split, count(*) as n, avg(score) as mean, " + ", ".join(f"quantile_cont(score, {x}) as q{int(x * 100)}" for x in (0.0, 0.1, 0.5, 0.9, 0.95, 0.99, 1.0)) + " from sc group by split"),
                                   s="split", i="n", d="mean q0 q10 q50 q90 q95 q99 q100"))
def score_distribution(spark, sf):
    return metrics.score_distribution(scored(spark, sf))


@query("interval_summary", table(q(
    "select split, count(*) as windows, count(*) filter (where stage > 0) as attack_windows, count(*) filter (where alarm) as alarmed_windows, avg(case when alarm then 1.0 else 0 end) as alarmed_share, "
    "count(*) filter (where stage > 0 and alarm) as alarmed_on_attack, count(*) filter (where stage = 0 and alarm) as alarmed_on_benign, avg(case when alarm then 1.0 else 0 end) filter (where stage > 0) as attack_alarmed_share, "
    "median(score) as score_median, max(score) as score_max, median(score) filter (where stage = 0) as benign_median from al group by split"),
    s="split", i="windows attack_windows alarmed_windows alarmed_on_attack alarmed_on_benign", d="alarmed_share attack_alarmed_share score_median score_max benign_median"))
def interval_summary(spark, sf):
    return metrics.interval_summary(alarmed(spark, sf))


_LO, _HI = "timestamp '2024-01-03 00:00:00'", "timestamp '2024-01-20 00:00:00'"


@query("between_times", table(q(
    f"select split, count(*) as windows, count(*) filter (where alarm) as alarmed, min(score) as score_min, median(score) as score_median, max(score) as score_max, "
    f"(select b.ts_us from al b where b.split = a.split and b.alarm and b.ts_us between epoch_us({_LO}) and epoch_us({_HI}) order by b.score desc, b.ts_us limit 1) as peak_ts "
    f"from al a where ts_us between epoch_us({_LO}) and epoch_us({_HI}) group by split"), s="split", i="windows alarmed peak_ts", d="score_min score_median score_max"))
def between_times(spark, sf):
    return metrics.between_times(alarmed(spark, sf), F.expr(_LO), F.expr(_HI))


@query("first_alarm_after", table(q(
    "select o.split, o.onset_w, min(r.begin_w) as first_alarm_w, (min(r.begin_w) - o.onset_w) * 30.0 as minutes_late from (select split, min(onset_w) as onset_w from ons_c group by split) o "
    "left join runs r on r.split = o.split and r.end_w >= o.onset_w group by o.split, o.onset_w"), s="split", i="onset_w first_alarm_w", d="minutes_late"))
def first_alarm_after(spark, sf):
    a = alarmed(spark, sf)
    onset = targets.episode_onsets(a, "compromise")
    return metrics.first_alarm_after(a, alerts.alarm_runs(a, onset, K, 1800.0), onset, 1800.0)


# ---- S13 -------------------------------------------------------------------------------------------------

@query("result_payload")
def result_payload(spark, sf):
    """One JSON document per split (text, so rows only here; its parts have oracles)."""
    from tidewatch.sources.dimensions import stage_catalogue_column
    a = alarmed(spark, sf)
    onset = targets.episode_onsets(a, "compromise")
    runs = alerts.alarm_runs(a, onset, K, 1800.0)
    leads = episodes.lead_summary(episodes.lead_times(a, onset, K, persistence=2), 1800.0)
    source = a.groupBy("split").agg(F.count("*").alias("windows"), F.min("ts").alias("t0"))
    return reports.payload(source, reports.timeline(a), runs, leads, stage_catalogue_column())


@query("payload_windows", table(q("select split, w // 100 as page, w, score, threshold, alarm from al"), s="split", i="page w alarm", d="score threshold"))
def payload_windows(spark, sf):
    """Every window read back from the documents, in pages of 100."""
    from tidewatch.sources.dimensions import stage_catalogue_column
    a = alarmed(spark, sf)
    onset = targets.episode_onsets(a, "compromise")
    runs = alerts.alarm_runs(a, onset, K, 1800.0)
    leads = episodes.lead_summary(episodes.lead_times(a, onset, K, persistence=2), 1800.0)
    source = a.groupBy("split").agg(F.count("*").alias("windows"))
    docs = reports.payload(source, reports.timeline(a), runs, leads, stage_catalogue_column(), page_windows=100)
    back = F.from_json("payload", "timeline array<struct<w: bigint, score: double, threshold: double, alarm: boolean>>")
    return docs.select("split", "page", F.explode(back["timeline"]).alias("t")).select("split", "page", "t.*")


@query("timeline_page", table(q("select split, w, score, threshold, alarm from al where w between 5 and 60"), s="split", i="w alarm", d="score threshold"))
def timeline_page(spark, sf):
    return reports.timeline(alarmed(spark, sf), 5, 60).select("split", "w", "score", "threshold", "alarm")
