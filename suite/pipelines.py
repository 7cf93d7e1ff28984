"""Queries that run whole pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite.base import INTERNAL, K, comparable, flows, grid_of, q, table
from tidewatch import WindowSpec, fixtures
from tidewatch.plans import build
from tidewatch.schema import BASE_FEATURES
from tidewatch.session import prepare

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = lambda spark, sf: comparable(fn(spark, sf))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


_TARGETS = "stage compromise attack_now escalate_step y_within_K y_attack_within_K y_escalate_within_K"


@query("labelled_states", table(q("select * from vec join tgt using (split, w)"), s="split", i="w ts_us " + _TARGETS, d=" ".join(BASE_FEATURES)))
def labelled_states(spark, sf):
    """The standard build: 70 features, stages and targets, one row per window."""
    rows = flows(spark, sf)
    states = build.build_states(rows, grid_of(rows), INTERNAL, K)
    return states.withColumnRenamed("ts", "ts_us").select("split", "w", "ts_us", *_TARGETS.split(), *BASE_FEATURES)


@query("capture_report")
def capture_report(spark, sf):
    """One capture analysed end to end into a JSON payload per split (text: rows only)."""
    rows = flows(spark, sf)
    return build.capture_report(rows, grid_of(rows), INTERNAL, lambda s: s.withColumn("score", F.col("uniq_dst_port")))


@query("states_from_packets")
def states_from_packets(spark, sf):
    """Packets -> flows -> states with the packet block (its parts have oracles).

    The packets are a projection of a table's rows: reading that again takes no disk, a written copy as much as the steps that read it.
    """
    packets = fixtures.packets(prepare(spark), sf)
    states, _ = build.states_from_packets(packets, INTERNAL, WindowSpec(60, 30), dedupe=False)
    return states
