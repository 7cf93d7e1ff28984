"""op5: toxicity of every document, learned from the labels."""

from __future__ import annotations

from tidewatch.llm.common import session, table
from tidewatch.llm.toxicity import scored


def op5_toxic_segments(spark, sf_dir):
    session(spark)
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op5_toxic_segments": op5_toxic_segments}
ORACLES = {}
