"""Query of operator 2."""

import public_tokenizers

from corpusgraph.llm.common import read_table
from corpusgraph.llm.token_counts import count_with_edits


def op2_token_counts(spark, sf_dir, path=None):
    return count_with_edits(read_table(spark, sf_dir, "documents"), path or public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op2_token_counts": op2_token_counts}
ORACLE_SQL: dict[str, str] = {}
