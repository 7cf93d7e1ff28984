"""Report-shaped outputs: flagged flows, nested result payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.columns import json_safe
from tidewatch.operators.grid import Grid

PAGE_WINDOWS = 5000


def flagged_flows(flows: DataFrame, scores: DataFrame, grid: Grid, stage: int, min_score: float, limit: int = 50) -> DataFrame:
    """The ``limit`` flows of a stage whose strongest window scores at least ``min_score``.

    Window scores are folded to slices first (a slice's best window), so each flow meets one row by an
    equi-join instead of being copied into its windows. The limit is the report's own top-k.
    """
    spec = grid.spec
    a, b = spec.slices_per_stride, spec.slices_per_window
    slices = F.explode(F.sequence(F.col("w") * a, F.col("w") * a + (b - 1)))
    best = (scores.where(F.col("score") >= min_score).select("split", slices.alias("slice_no"), "score")
            .groupBy("split", "slice_no").agg(F.max("score").alias("score")))
    hits = grid.locate(flows.where(F.col("stage") == stage)).join(best, ["split", "slice_no"])
    tie = "flow_id" if "flow_id" in flows.columns else "ts"
    return hits.orderBy(F.desc("score"), tie).limit(limit).drop("off_us", "slice_no", "n")


def timeline(states: DataFrame, page_from: int = 0, page_to: int | None = None) -> DataFrame:
    """The per-window timeline from ``page_from`` to ``page_to`` (or the end), numbers JSON-safe."""
    rows = states.where(F.col("w") >= page_from)
    rows = rows if page_to is None else rows.where(F.col("w") <= page_to)
    kinds = dict(rows.dtypes)
    return rows.select(*(json_safe(F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in rows.columns))


def payload(source: DataFrame, rows: DataFrame, alarms: DataFrame, leads: DataFrame, stages: Column, page_windows: int = PAGE_WINDOWS) -> DataFrame:
    """JSON documents ``(split, page, payload)``: source facts, timeline, alarm runs and lead summary.

    All windows of ``rows`` are in some page; ``page_windows`` only sets how many documents a long split has, which bounds
    a document's arrays. Alarm runs stand in the page where they begin. A split without windows has page 0.
    """
    def listed(df: DataFrame, name: str, order: str) -> DataFrame:
        page = F.expr(f"{order} div {page_windows}").alias("page")
        item = F.struct(F.col(order).alias("_o"), *(F.col(c) for c in df.columns if c != "split"))
        return df.groupBy("split", page).agg(F.sort_array(F.collect_list(item)).alias(name)).withColumn(
            name, F.transform(name, lambda x: x.dropFields("_o")))

    pages = listed(rows, "timeline", "w").join(listed(alarms, "alarms", "begin_w"), ["split", "page"], "full")
    doc = source.join(pages, "split", "left").join(
        leads.select("split", F.struct(*(c for c in leads.columns if c != "split")).alias("lead_time_summary")), "split", "left")
    doc = doc.withColumns({"stages": stages, "alarms": F.coalesce("alarms", F.array()), "page": F.coalesce("page", F.lit(0).cast("long"))})
    return doc.select("split", "page", F.to_json(F.struct(*(c for c in doc.columns if c != "split")),
                                                 {"ignoreNullFields": "false"}).alias("payload"))
