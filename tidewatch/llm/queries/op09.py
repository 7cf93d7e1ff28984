"""op9: word, symbol and repetition counts of every document, and the verdict of the compression bands."""

from __future__ import annotations

from tidewatch.llm.common import session, table
from tidewatch.llm.compression import judged


def op9_compression_bands(spark, sf_dir):
    session(spark)
    return judged(table(spark, sf_dir, "documents"))


QUERIES = {"op9_compression_bands": op9_compression_bands}
ORACLES = {}
