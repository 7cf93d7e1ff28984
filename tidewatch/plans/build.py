"""Whole pipelines: flows -> states, packets -> states, one capture -> report."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import alerts, blocks, episodes, packets as packet_ops, reports, state, targets
from tidewatch.operators.flows import assemble_flows
from tidewatch.operators.grid import Grid, WindowSpec
from tidewatch.schema import HORIZON, PACKET_STAT_COLUMNS, target_names
from tidewatch.session import cut_lineage, kept_apart, let_go
from tidewatch.sources.dimensions import stage_catalogue_column

Scorer = Callable[[DataFrame], DataFrame]


def build_states(flows: DataFrame, grid: Grid, internal: tuple[str, ...], horizon: int = HORIZON, trend: bool = False, host_slots: int = 0,
                 flow_packets: bool = False, host_relative: bool = False, packet_windows: DataFrame | None = None,
                 labelled: bool = True, apart: bool = False) -> DataFrame:
    """The state matrix: (split, w, ts, features, [targets]), one row per window.

    Optional blocks are joined on (split, w): each side is one row per window, already partitioned alike. ``apart``: see ``state_vector``.
    """
    out = state.state_vector(flows, grid, internal, apart)
    if trend:
        out = blocks.trend_features(out)
    if host_slots:
        out = out.join(blocks.host_slots(flows, grid, internal, host_slots), ["split", "w"])
    if flow_packets:
        out = out.join(blocks.flow_packet_features(flows, grid, internal), ["split", "w"])
    if host_relative:
        out = out.join(blocks.host_relative_features(flows, grid, internal), ["split", "w"])
    if packet_windows is not None:
        out = packet_ops.with_packets(out, packet_windows)
    if labelled:
        stages = targets.with_targets(state.window_stages(flows, grid), horizon).select("split", "w", *target_names(horizon))
        out = out.join(stages, ["split", "w"])
    return out


def states_from_packets(packets: DataFrame, internal: tuple[str, ...], spec: WindowSpec = WindowSpec(), dedupe: bool = True) -> tuple[DataFrame, Grid]:
    """A capture's states: flows assembled from its packets plus the measured packet block; no labels exist.

    Packets and flows are the bulk, so what is made of them is made one after the other: each step's shuffles are gone before the
    next begins, and only flows and rows per window stay. ``packets`` is read several times.
    """
    rows = packets.where(~F.coalesce("skipped", F.lit(False))) if "skipped" in packets.columns else packets
    if dedupe and "ip_digest" in rows.columns:
        rows = packet_ops.drop_capture_duplicates(rows)
    flows = kept_apart(assemble_flows(rows).drop(*PACKET_STAT_COLUMNS))  # read by every feature family
    let_go(packets.sparkSession)
    grid = Grid.fit(flows, spec)
    again = kept_apart(packet_ops.retransmissions_by_slice(rows, grid))
    let_go(packets.sparkSession)
    measured = kept_apart(packet_ops.packet_window_features(rows, grid, again))
    return build_states(flows, grid, internal, packet_windows=measured, labelled=False, apart=True), grid


def capture_report(flows: DataFrame, grid: Grid, internal: tuple[str, ...], scorer: Scorer, budget: float = 0.10, horizon: int = HORIZON,
                   labelled: bool = True) -> DataFrame:
    """One capture analysed: states, scores, causal alarms, runs, lead summary and one JSON payload per split.

    ``scorer`` is any ``states -> states + score`` transform: a fitted model's ``score`` or the user's own.
    """
    stride = grid.spec.stride_s
    states = build_states(flows, grid, internal, horizon, labelled=labelled)
    scored = alerts.causal_threshold(scorer(states), 1.0 - budget)
    alarms = cut_lineage(scored.join(state.top_talkers(flows, grid), ["split", "w"], "left"))
    shown = ["split", "w", "ts", "score", "threshold", "alarm", "n_flows", "top_talkers"]
    source = alarms.groupBy("split").agg(F.count("*").alias("windows"), F.min("ts").alias("t0"), F.count_if("alarm").alias("alarmed"))
    if labelled:
        shown.append("stage")
        onset = targets.episode_onsets(alarms, "compromise")
        leads = episodes.lead_summary(episodes.lead_times(alarms, onset, horizon, persistence=2), stride)
        runs = alerts.alarm_runs(alarms, onset, horizon, stride)
    else:
        runs = alerts.alarm_runs(alarms, None, horizon, stride)
        leads = source.where(F.lit(False)).select("split", "windows")
    return reports.payload(source, reports.timeline(alarms.select(*shown)), runs, leads, stage_catalogue_column())
