"""Model calls as a batched operator, and the evaluation of recorded answers."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailhead.functions import text as t

THRESHOLD = 0.6
ANSWER = "struct<purpose_behavior: string, return_type: string, return_description: string, error: string>"


def asked(prompts: DataFrame, client: Callable[[], Callable[[str], str]] | None, retries: int = 3, wait: float = 1.0) -> DataFrame:
    """prompts (id, prompt) with response, success, attempts and error.

    client makes a function from prompt to response, once for each task; without one nothing
    is asked and every row has no success, so that callers fall back to their rules. Failures
    are tried again after 1, 2, 4 ... times the wait.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = client() if client else None
        for frame in frames:
            rows = []
            for id_, prompt in zip(frame["id"], frame["prompt"], strict=True):
                response, error, attempt = None, None if ask else "no client", 0
                while ask and attempt < retries and response is None:
                    attempt += 1
                    try:
                        response, error = ask(prompt), None
                    except Exception as failure:  # whatever a client raises is recorded with its row
                        error = f"{type(failure).__name__}: {failure}"
                        if attempt < retries:
                            time.sleep(wait * 2 ** (attempt - 1))
                rows.append((id_, prompt, response, response is not None, attempt, error))
            yield pd.DataFrame(rows, columns=["id", "prompt", "response", "success", "attempts", "error"])

    return prompts.select(F.col("id").cast("string").alias("id"), "prompt").mapInPandas(run, "id string, prompt string, response string, success boolean, attempts int, error string")


def with_fallback(answers: DataFrame, fallback: str = "fallback") -> DataFrame:
    """The structured parts of each response, or the fallback text in all formats."""
    parsed = t.structured_response("response")
    pick = lambda name: F.coalesce(F.col("p")[name], F.col(fallback)).alias(name)
    return answers.withColumn("p", parsed).select("id", F.coalesce("p.branch", F.lit(True)).alias("branch"), pick("format1"), pick("format2"), pick("format3"), F.col("p").isNotNull().alias("from_model"))


def parsed_answer(response) -> F.Column:
    """The JSON object of an answer, fenced or not; error is set where it can't be read or lacks a field."""
    c = F.regexp_replace(F.trim(response, F.lit(" \t\r\n")), r"^```(?:json)?\s*|\s*```$", "")
    made = F.from_json(c, "struct<purpose_behavior: string, return_values: struct<type: string, description: string>>")
    missing = made.isNull() | made["purpose_behavior"].isNull()
    return F.struct(
        made["purpose_behavior"].alias("purpose_behavior"), F.coalesce(made["return_values"]["type"], F.lit("")).alias("return_type"),
        F.coalesce(made["return_values"]["description"], F.lit("")).alias("return_description"), F.when(missing, "unreadable answer").alias("error"),
    )


def similarity(rows: DataFrame) -> DataFrame:
    """purpose, return_type and description likeness and their overall mean.

    rows have vectors true_purpose, got_purpose, true_description, got_description and the
    types true_type, got_type, which count as equal without case and outer spaces.
    """
    same = F.when(F.lower(F.trim("true_type")) == F.lower(F.trim("got_type")), 1.0).otherwise(0.0)
    made = rows.withColumn("purpose", t.cosine("true_purpose", "got_purpose")).withColumn("return_type", same).withColumn("description", t.cosine("true_description", "got_description"))
    return made.withColumn("overall", (F.col("purpose") + F.col("return_type") + F.col("description")) / 3).withColumn("good", F.col("overall") >= THRESHOLD)


def pending(methods: DataFrame, models: DataFrame, done: DataFrame) -> DataFrame:
    """(sig, model) pairs that have no record yet; models is a short list, so each method row is exploded over it."""
    names = F.array(*(F.lit(r[0]) for r in models.select("model").distinct().orderBy("model").collect()))
    return methods.select("sig", F.explode(names).alias("model")).join(done.select("sig", "model").distinct(), ["sig", "model"], "left_anti")


def invalid_truth(methods: DataFrame) -> DataFrame:
    """Ground-truth rows that lack what a comparison needs."""
    return methods.where(F.coalesce(F.trim("sig"), F.lit("")).eqNullSafe("") | F.coalesce(F.trim("purpose"), F.lit("")).eqNullSafe(""))
