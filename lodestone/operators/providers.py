"""Models as functions on rows, and what is parsed from their replies."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.config import RETRIEVAL_DEPTH
from lodestone.operators.prompts import NO_CONTEXT, question_turn

VERDICTS = {"correct": 1.0, "partial": 0.5, "incorrect": 0.0}


def complete(rows: DataFrame, prompt: str, model: Callable[[list[str]], list[str]], into: str = "answer", batch: int = 64) -> DataFrame:
    """``rows`` with the model's reply to each prompt, asked for in batches.

    Rows that need no call must be filtered before: a condition around a Python function does not guard it.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            out: list[str] = []
            for lo in range(0, len(prompts), batch):
                out += model(prompts.iloc[lo : lo + batch].tolist())
            yield pd.Series(out, dtype=object)

    return rows.withColumn(into, F.pandas_udf(run, "string")(F.col(prompt)))


def echo(prompts: list[str]) -> list[str]:
    """A provider without a model: the prompt's last line."""
    return [p.rsplit("\n", 1)[-1] for p in prompts]


def scripted(replies: dict[str, str], default: str = "") -> Callable[[list[str]], list[str]]:
    """A provider with a fixed reply for each prompt that contains a key."""
    return lambda prompts: [next((r for k, r in replies.items() if k in p), default) for p in prompts]


PROVIDERS: dict[str, Callable] = {"echo": lambda: echo, "scripted": scripted}


#: Variables that hold the credentials of providers which need some.
CREDENTIALS: dict[str, str] = {}


def has_credentials(name: str) -> bool:
    return name not in CREDENTIALS or bool(os.environ.get(CREDENTIALS[name]))


def register_provider(name: str, build: Callable, credential: str | None = None) -> None:
    """Adds a provider: ``build(*args)`` gives a function from prompts to replies."""
    PROVIDERS[name] = build
    if credential:
        CREDENTIALS[name] = credential


def get_provider(name: str, *args):
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider {name!r}; known: {', '.join(sorted(PROVIDERS))}")
    if not has_credentials(name):
        raise ValueError(f"provider {name!r} needs {CREDENTIALS[name]} to be set")
    return PROVIDERS[name](*args)


def answer_questions(questions: DataFrame, evidence: DataFrame, model, key: str = "query_id") -> DataFrame:
    """Plain answers: one prompt of a question's excerpts (key, rank, place, kind, symbol, language, code); no evidence, no call."""
    from lodestone.operators.agent import evidence_pack

    packed = questions.join(evidence_pack(evidence, key), key, "left")
    asked = packed.filter("excerpts > 0").withColumn("prompt", question_turn(F.col("question"), F.col("context"), F.col("excerpts")))
    answered = complete(asked, "prompt", model).select(key, "answer", "excerpts")
    silent = packed.filter("excerpts IS NULL").select(key, F.lit(NO_CONTEXT).alias("answer"), F.lit(0).cast("long").alias("excerpts"))
    return answered.unionByName(silent)


def parse_verdict(reply: Column) -> Column:
    """A judge's verdict: the first VERDICT line's first word, ``partial`` for anything else."""
    word = F.lower(F.regexp_extract(reply, r"(?im)^[ \t]*VERDICT[ \t]*:[ \t]*(\S*)", 1))
    return F.when(word.isin(*VERDICTS), word).otherwise("partial")


def verdict_score(verdict: Column) -> Column:
    score = F.lit(0.0)
    for name, value in VERDICTS.items():
        score = F.when(verdict == name, value).otherwise(score)
    return score


def stream_text(replies: DataFrame, key: str, body: str) -> DataFrame:
    """key, text, output_tokens of streamed replies: data lines up to ``[DONE]``, other lines and broken JSON skipped."""
    line = F.explode(F.transform(F.split(body, "\r?\n", -1), lambda x, i: F.struct(i.alias("i"), x.alias("x")))).alias("l")
    rows = replies.select(key, line).select(key, "l.i", "l.x").filter(F.startswith("x", F.lit("data:")))
    rows = rows.withColumn("d", F.trim(F.substring("x", 6, 1 << 30)))
    done = rows.filter("d = '[DONE]'").groupBy(key).agg(F.min("i").alias("stop"))
    kind = "choices array<struct<delta:struct<content:string>>>, usage struct<completion_tokens:int>"
    seen = rows.join(done, key, "left").filter("stop IS NULL OR i < stop").withColumn("j", F.from_json("d", kind))
    parts = F.array_sort(F.collect_list(F.struct("i", F.coalesce(F.get(F.col("j.choices"), F.lit(0))["delta"]["content"], F.lit("")).alias("t"))))
    return seen.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["t"]), "").alias("text"), F.max("j.usage.completion_tokens").alias("output_tokens"))


# ------------------------------------------------------------------ evaluation runs


def fingerprint(**settings) -> Column:
    """Ten characters that name a set of settings."""
    return F.left(F.sha2(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in sorted(settings.items())])), 256), F.lit(10))


def pending(work: DataFrame, prior: DataFrame, keys: list[str]) -> DataFrame:
    """The work without an outcome yet."""
    return work.join(prior.select(*keys), keys, "left_anti")


def run_ablation(questions: DataFrame, configs: dict[str, Callable[[DataFrame], DataFrame]], prior: DataFrame | None = None) -> DataFrame:
    """Outcomes of every configuration over the questions; those that ``prior`` holds are reused, not run.

    A configuration maps (question_id, question) rows to (question_id, position, answer_id, answer) rows.
    """
    out = prior
    for name, run in configs.items():
        todo = questions.withColumn("config", F.lit(name))
        if prior is not None:
            todo = pending(todo, prior, ["config", "question_id"])
        found = run(todo).filter(F.col("position") <= RETRIEVAL_DEPTH).withColumn("config", F.lit(name))
        out = found if out is None else out.unionByName(found, allowMissingColumns=True)
    return out
