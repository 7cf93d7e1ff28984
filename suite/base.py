"""Shared pieces: comparable output types, oracle CTEs over the fixture flows, and the fixture's derived tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch import Grid, WindowSpec, fixtures
from tidewatch.operators import state, targets
from tidewatch.session import prepare

SPEC = WindowSpec(3600, 1800)
INTERNAL = fixtures.INTERNAL
K = 10


def comparable(df: DataFrame) -> DataFrame:
    """Doubles to 6 decimals (no negative zero), integers and booleans to BIGINT, timestamps to microseconds."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float") or kind.startswith("decimal"):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint", "boolean"):
            c = c.cast("bigint") if kind != "boolean" else c.cast("int").cast("bigint")
        elif kind.startswith("timestamp"):
            c = F.unix_micros(c.cast("timestamp"))
        out.append(c.alias(name))
    return df.select(*out)


def table(sql: str, s: str = "", i: str = "", d: str = "") -> str:
    """Oracle text with the same types: strings, BIGINTs, doubles rounded to 6."""
    cols = [f"cast({c} as varchar) as {c}" for c in s.split()]
    cols += [f"cast({c} as bigint) as {c}" for c in i.split()]
    cols += [f"round(cast({c} as double), 6) + 0.0 as {c}" for c in d.split()]
    return f"select {', '.join(cols)} from ({sql}) as result_rows"


#: oracle CTEs in dependency order; ``q`` keeps the ones a query mentions
CTES: dict[str, str] = {}


def cte(name: str, text: str) -> None:
    CTES[name] = text


def q(sql: str) -> str:
    """``sql`` with every CTE it needs, directly or through others, in front."""
    need: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                visit(CTES[name])

    visit(sql)
    head = ", ".join(f"{name} as ({CTES[name]})" for name in CTES if name in need)
    return f"with {head} {sql}" if head else sql


_cols = ", ".join(f"{text} as {name}" for name, text in fixtures.FLOW_SQL.items() if name != "ts")
cte("fx0", f"select *, {fixtures._K} as k from events")
cte("fx1", f"select cast(ts as timestamp) as ts, {_cols} from fx0")
cte("fx", f"select *, {fixtures.STAGE_SQL} as stage, label like '%Attempted%' as attempted from fx1")
cte("gr", "select split, epoch_us(date_trunc('minute', min(ts))) as t0_us, "
          "(epoch_us(max(ts)) - epoch_us(date_trunc('minute', min(ts)))) // 1800000000 + 1 as n from fx group by split")
cte("sp", "select split, t0_us + w * 1800000000 as ts_us, w from (select split, t0_us, unnest(generate_series(0, n - 1)) as w from gr)")
cte("ex0", "select fx.*, gr.n, epoch_us(ts) - t0_us as off_us from fx join gr using (split)")
cte("ex", "select *, unnest(generate_series(greatest(0, cast(floor((off_us - 3600000000) / 1800000000.0) as bigint) + 1), "
          "off_us // 1800000000)) as w from ex0")
cte("inx", "select * from ex where starts_with(src_ip, '192.168.10.')")
cte("flags", "select split, w, max(case when s between 1 and 5 then s else 0 end) as prog, max(case when s = 6 then 1 else 0 end) as imp, "
             + ", ".join(f"max(case when s = {i} then 1 else 0 end) as s{i}" for i in range(1, 7))
             + " from (select split, w, case when attempted then 0 else stage end as s from ex) group by split, w")
cte("st", "select sp.split, sp.w, coalesce(case when prog > 0 then prog when imp > 0 then 6 else 0 end, 0) as stage, "
          + ", ".join(f"coalesce(s{i}, 0) as s{i}" for i in range(1, 7))
          + " from sp left join flags using (split, w)")


def flows(spark: SparkSession, sf: str) -> DataFrame:
    prepare(spark)
    return fixtures.flows(spark, sf)


def grid_of(rows: DataFrame) -> Grid:
    return Grid.fit(rows, SPEC)


def stages(spark: SparkSession, sf: str) -> DataFrame:
    rows = flows(spark, sf)
    return state.window_stages(rows, grid_of(rows))


def labelled_states(spark: SparkSession, sf: str) -> DataFrame:
    return targets.with_targets(stages(spark, sf), K)
