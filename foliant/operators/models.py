"""Contracts around model calls: embedding, generation and judging run outside, as batch functions.

A model is a function from a list of texts to a list of results; it is called once per Arrow batch on the
executors. ``hashed_embedding`` of the chunking module stands in for an embedding model in tests.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from foliant.functions import jsonx as J, text as T
from foliant.shipping import ship, spread


def embed(df: DataFrame, text: str, model: Callable[[list[str]], list[Sequence[float]]], dimensions: int, out: str = "embedding") -> DataFrame:
    """Vectors of a column; a batch on which the model fails gets zero vectors."""
    ship(df.sparkSession)

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            try:
                vectors = [list(map(float, v)) for v in model(part.fillna("").tolist())]
            except Exception:  # a model may fail in any way
                vectors = [[0.0] * dimensions] * len(part)
            yield pd.Series(vectors)

    return df.withColumn(out, run(F.col(text)))


def embed_all(df: DataFrame, text: str, models: Mapping[str, tuple[Callable[[list[str]], list[Sequence[float]]], int]], out: str = "vectors") -> DataFrame:
    """Named vectors of a column, one a model, each model with its number of dimensions."""
    for name, (model, dimensions) in models.items():
        df = embed(df, text, model, dimensions, f"_vector_{name}")
    named = F.struct(*[F.col(f"_vector_{name}").alias(name) for name in models])
    return df.withColumn(out, named).drop(*[f"_vector_{name}" for name in models])


def judged(items: DataFrame, prompt: str, model: Callable[[list[str]], list[str]], fields: Sequence[str], attempts: int = 3, batch: int = 50) -> DataFrame:
    """``status, scores``: a judge's scores by field from its JSON answer; a failed or unreadable one is all zeros."""
    asked = generate(items, prompt, model, "_answer", attempts=attempts, batch=batch)
    read = F.from_json(F.col("_answer"), ", ".join(f"`{f}` double" for f in fields))
    status = F.when(F.col("error").isNotNull(), "judge_error").when(J.parsed_object(F.col("_answer")).isNull(), "parsing_error").otherwise("success")
    scores = F.struct(*[F.when(status == "success", F.coalesce(read[f], F.lit(0.0))).otherwise(0.0).alias(f) for f in fields])
    return asked.select(*items.columns, status.alias("status"), scores.alias("scores"))


def generate(df: DataFrame, prompt: str, model: Callable[[list[str]], list[str]], out: str = "answer", most_chars: int = 150_000, attempts: int = 3, batch: int = 50, wait: float = 0.0) -> DataFrame:
    """Answers and errors of a prompt column, asked in batches; a batch is tried several times, with waits that
    double from ``wait`` seconds, then its error is kept."""
    ship(df.sparkSession)

    @F.pandas_udf("struct<answer:string,error:string>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for whole in parts:
            prompts, told, errors = whole.fillna("").str.slice(0, most_chars).tolist(), [], []
            for at in range(0, len(prompts), batch):
                part = prompts[at : at + batch]
                error, answers = None, [None] * len(part)
                for attempt in range(attempts):
                    try:
                        answers, error = model(part), None
                        break
                    except Exception as problem:  # a model may fail in any way
                        error = f"{type(problem).__name__}: {problem}"
                        time.sleep(wait * 2**attempt if attempt + 1 < attempts else 0)
                if len(answers) != len(part):
                    raise ValueError(f"{len(answers)} answers to {len(part)} prompts")
                told += list(answers)
                errors += [error] * len(part)
            yield pd.DataFrame({"answer": pd.Series(told, dtype=object), "error": pd.Series(errors, dtype=object)})

    return spread(df).withColumn("_g", run.asNondeterministic()(F.col(prompt))).select(*df.columns, F.col("_g.answer").alias(out), F.col("_g.error").alias("error"))


def judge_requests(items: DataFrame, template: str, fields: Sequence[str], model: str, schema_name: str = "scores", key: str = "idx") -> DataFrame:
    """One JSON request line per item, under a ``custom_id``, with a strict response schema of numbers."""
    prompt = T.rendered(template, {f: F.col(f) for f in fields if f in items.columns})
    message = F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content")))
    properties = F.struct(*[F.struct(F.lit("number").alias("type")).alias(f) for f in fields])
    schema = F.struct(F.lit("object").alias("type"), properties.alias("properties"), F.array(*[F.lit(f) for f in fields]).alias("required"), F.lit(False).alias("additionalProperties"))
    form = F.struct(F.lit("json_schema").alias("type"), F.struct(F.lit(schema_name).alias("name"), F.lit(True).alias("strict"), schema.alias("schema")).alias("json_schema"))
    body = F.struct(F.lit(model).alias("model"), message.alias("messages"), form.alias("response_format"))
    identity = F.col(key).cast("string")
    return items.select(identity.alias("custom_id"), F.to_json(F.struct(identity.alias("custom_id"), F.lit("POST").alias("method"), body.alias("body"))).alias("request"))


def message_tokens(messages: Column) -> Column:
    """Tokens of a message list: those between white space, three a message and three more."""
    return F.aggregate(messages, F.lit(3), lambda total, m: total + 3 + F.size(T.tokens(m["content"])))


def cost(df: DataFrame, prices: Mapping[str, float]) -> DataFrame:
    """Summed tokens and price over columns of token counts, priced per thousand."""
    total = sum((F.coalesce(F.sum(c), F.lit(0)) * F.lit(p / 1000) for c, p in prices.items()), F.lit(0.0))
    return df.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in prices], total.alias("cost"))


def legacy_field_means(scores: DataFrame) -> DataFrame:
    """Unweighted mean per field over parsed items alone (parse failures are left out of the means)."""
    return scores.groupBy("field").agg(F.avg("value").alias("mean"), F.count("value").alias("n"))
