"""All queries of this folder: `QUERIES` and `SQL`."""

from importlib import import_module

from valuary.llm.registry import QUERIES, SQL  # noqa: F401

MODULES = (
    "op1_token_output",
    "op2_exact_top_k",
    "op3_byte_bpe",
    "op4_minhash_dedup",
    "op5_secret_scans",
    "op6_token_counts",
    "op7_packing",
    "op8_substring_dedup",
    "op9_quality_classifier",
    "op10_quality_rules",
    "op11_pii",
    "op12_conversation_repair",
    "op13_merkle_manifest",
)

for _module in MODULES:
    import_module(f"valuary.llm.{_module}")

corpus_pipeline = import_module("corpus_pipeline")
QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
