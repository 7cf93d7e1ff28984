"""op7: personal data in every document; base spans by fixed rules, others by the boosted trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.llm.common import session, table
from tidewatch.llm.pii import BASE, found, joined


def op7_pii_boosted_candidates(spark, sf_dir):
    session(spark)
    rows = found(table(spark, sf_dir, "documents"))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    numbers = [number(kind) for kind in BASE]
    return rows.select("doc_id", *numbers, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                       joined(F.concat("base", "added")).alias("spans"))


QUERIES = {"op7_pii_boosted_candidates": op7_pii_boosted_candidates}
ORACLES = {}
