"""The training-data pipeline of the optional subpackage: its stages, and run(spark, sf_dir), which applies them to documents."""

from corpusgraph.llm.pipeline import ORACLE_SQL, STAGES, decontaminate, encode, near_dedup, quality_filter, run, suffix_dedup_stage

__all__ = ["ORACLE_SQL", "STAGES", "decontaminate", "encode", "near_dedup", "quality_filter", "run", "suffix_dedup_stage"]
