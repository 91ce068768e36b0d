"""From hits to an answer: prompt, model, leak guard, and what the run used."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from corpusgraph.operators.enrich import ask
from corpusgraph.operators.retrieval import RetrievalOptions, build_prompts
from corpusgraph.operators.rules import leak_guard

NO_ANSWER = "The model gave no answer."


def watch_private(hits: DataFrame, observation: Observation) -> DataFrame:
    """hits as they are; the observation gets the number of private ones when they are read."""
    return hits.observe(observation, F.count("*").alias("n_hits"), F.count_if(F.coalesce("is_private", F.lit(False))).alias("n_private"))


def answer(hits: DataFrame, question: str, complete: Callable[[str], str] | None = None, group: str = "query_id", options: RetrievalOptions = RetrievalOptions()) -> DataFrame:
    """(group, prompt, chunk_tokens, total_tokens, answer): every answer has passed the leak guard; without a model it is null."""
    prompts = build_prompts(hits, question, group, options)
    if complete is None:
        return prompts.withColumn("answer", F.lit(None).cast("string"))
    said = ask(prompts, F.col("prompt"), F.lit(NO_ANSWER), complete, "answer")
    return said.withColumn("answer", leak_guard("answer"))
