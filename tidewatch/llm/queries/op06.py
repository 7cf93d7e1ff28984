"""op6: the language of every document."""

from __future__ import annotations

from tidewatch.llm.common import session, table
from tidewatch.llm.langid import predicted


def op6_language_id(spark, sf_dir):
    session(spark)
    return predicted(table(spark, sf_dir, "documents"))


QUERIES = {"op6_language_id": op6_language_id}
ORACLES = {}
