"""op4: token ids of every document written to block files in id order and read back."""

from __future__ import annotations

import public_tokenizers

from tidewatch.llm import token_files
from tidewatch.llm.common import session, table


def op4_token_id_files(spark, sf_dir):
    session(spark)
    folder = token_files.shared_folder(spark)
    token_files.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN,
                      special_as_text=False)
    return token_files.read(spark, folder)


QUERIES = {"op4_token_id_files": op4_token_id_files}
ORACLES = {}
