"""op2: documents that hold benchmark items, with the items and their edits."""

from __future__ import annotations

from tidewatch.llm.common import session, table
from tidewatch.llm.decontaminate import leaks


def op2_benchmark_decontamination(spark, sf_dir):
    session(spark)
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op2_benchmark_decontamination": op2_benchmark_decontamination}
ORACLES = {}
