"""op13: the quality of every document."""

from __future__ import annotations

from tidewatch.llm.common import session, table
from tidewatch.llm.subword_quality import scored


def op13_subword_quality(spark, sf_dir):
    session(spark)
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op13_subword_quality": op13_subword_quality}
ORACLES = {}
