"""op10: token ids of every document by the public multi-language vocabulary, and back."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tidewatch.llm.bpe import round_trip
from tidewatch.llm.common import session, table


def op10_byte_bpe(spark, sf_dir):
    session(spark)
    both = round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op10_byte_bpe": op10_byte_bpe}
ORACLES = {}
