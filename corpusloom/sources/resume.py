"""Batches of questions that can be killed and go on.

A run is a folder: ``questions`` holds what was asked, in order, ``results`` a folder for each micro-batch. A question's key is its
place and the hash of its text, so a list that was changed or reordered is refused, and each key is answered once: a micro-batch that is repeated after a crash
replaces its own folder, and leaves out what other folders hold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.incremental import question_key
from corpusloom.sources.storage import table_or_none

_QUESTIONS = "key string, index long, question string"


class WrongQuestions(ValueError):
    """The questions aren't those the run began with."""


def begin(path: str, questions: DataFrame, files: int = 8) -> DataFrame:
    """Writes the questions (index, question) of a new run, or checks that a run in ``path`` began with the same ones in the same order.

    Places are 1, 2, 3, ...; a gap or a repeated place raises, as does a null question. Returns (key, index, question).
    """
    spark = questions.sparkSession
    asked = questions.select(question_key(F.col("index"), F.col("question")).alias("key"), F.col("index").cast("long").alias("index"), "question")
    n, places, low, high, without = asked.agg(F.count("*"), F.countDistinct("index"), F.min("index"), F.max("index"), F.count_if(F.col("key").isNull())).first()
    if n and (places != n or low != 1 or high != n or without):
        raise WrongQuestions(f"places of {n} questions must be 1 to {n}, each once, and none null")
    held = table_or_none(spark, f"{path}/questions", _QUESTIONS)
    if held is None:
        asked.repartitionByRange(files, "index").write.parquet(f"{path}/questions")
        return spark.read.schema(_QUESTIONS).parquet(f"{path}/questions")
    other = held.select("index", F.col("key").alias("_held")).join(asked.select("index", "key"), "index", "full_outer").filter(~F.col("key").eqNullSafe(F.col("_held")))
    if (first := other.agg(F.min("index")).first()[0]) is not None:
        raise WrongQuestions(f"question {first} isn't the one this run began with")
    return held


def run(spark: SparkSession, path: str, answer: Callable[[DataFrame], DataFrame], files_per_batch: int = 1) -> None:
    """Answers the questions of a run that have no result yet, in micro-batches, and returns when all are done.

    ``answer`` takes (key, index, question) and returns rows with a key; it is given each question at most once
    unless its micro-batch didn't finish. An error ends the call; the next one goes on from there.
    """
    stream = spark.readStream.schema(_QUESTIONS).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path}/questions")

    def each(batch: DataFrame, number: int) -> None:
        done = results(spark, path)
        if done is not None:
            batch = batch.join(done.filter(F.col("batch") != number).select("key"), "key", "left_anti")
        answer(batch).write.mode("overwrite").parquet(f"{path}/results/batch={number}")

    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    query.awaitTermination()


def results(spark: SparkSession, path: str) -> DataFrame | None:
    """All results so far, with the micro-batch each came from; None before the first."""
    folder = f"{path}/results"
    if table_or_none(spark, folder, "key string") is None:
        return None
    return spark.read.option("basePath", folder).parquet(folder)


def finished(spark: SparkSession, path: str) -> DataFrame:
    """The results of a whole run with the index of their question, for reading in order; raises where a question has no result, or more than one, or a result no question."""
    asked = spark.read.schema(_QUESTIONS).parquet(f"{path}/questions")
    found = results(spark, path)
    if found is None:
        found = spark.createDataFrame([], "key string, batch int")
    both = asked.select("key", "index").join(found.groupBy("key").agg(F.count("*").alias("_n")), "key", "full_outer")
    index, key = both.filter(F.col("index").isNull() | F.col("_n").isNull() | (F.col("_n") > 1)).agg(F.min("index"), F.min("key")).first()
    if key is not None:
        raise RuntimeError(f"question {index} has no result, or more than one" if index is not None else f"{key} is no question of this run")
    return found.drop("batch").join(asked.select("key", "index"), "key")
