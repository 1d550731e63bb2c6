"""Question answering: context and prompt as columns, the model as a caller's function."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYSTEM = "You answer questions from the given context. If the context has no answer, say so."
NO_CONTEXT = "No relevant information found to answer the question."


def context(results: DataFrame) -> DataFrame:
    """(context): the results' texts in rank order, empty ones dropped, a blank line between. Results are few: a top-k."""
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("combined_score")).alias("s"), "doc_id", "chunk_text")))
    texts = F.filter(F.flatten(F.transform(ranked, lambda x: x["chunk_text"])), lambda t: t != "")
    return results.agg(F.array_join(texts, "\n\n").alias("context"))


def prompt(context: Column, question: Column | str) -> Column:
    question = F.lit(question) if isinstance(question, str) else question
    return F.concat(F.lit("Context: "), context, F.lit("\n\nQuestion: "), question)


def answer(results: DataFrame, question: str, model: Callable[[str, str], str]) -> str:
    """The model's answer to (system message, prompt); a fixed sentence if nothing was found."""
    row = context(results).select("context", prompt(F.col("context"), question).alias("prompt")).first()
    return model(SYSTEM, row["prompt"]) if row["context"] else NO_CONTEXT
