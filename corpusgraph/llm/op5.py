"""Query of operator 5."""

import public_tokenizers

from corpusgraph.llm.bpe import build_lexicon, encode_documents
from corpusgraph.llm.common import read_table


def op5_bpe_encode_decode(spark, sf_dir, path=None):
    docs = read_table(spark, sf_dir, "documents")
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    return encode_documents(docs, path, build_lexicon(docs, path), ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"))


QUERIES = {"op5_bpe_encode_decode": op5_bpe_encode_decode}
ORACLE_SQL: dict[str, str] = {}
