"""Where models come in: small interfaces, with offline stand-ins that need no network. Calls are made in batches inside tasks."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import text as tx


class ChatModel(Protocol):
    """Answers a prompt with a JSON object as text."""

    def __call__(self, prompt: str) -> str: ...


def offline_model(prompt: str) -> str:
    """Stands in for a language model: claims that sentences of the form "X: Y increases|decreases" state, nothing else."""
    claims = []
    for material, prop, verb in re.findall(r"([^\n.:]+): ([^\n.:]+?) (increases|decreases)\b", prompt):
        claims.append({"material": material.strip(), "property": prop.strip(), "effect_direction": verb[:-1], "quote": f"{material.strip()}: {prop} {verb}", "confidence": 0.9})
    return json.dumps({"claims": claims}, ensure_ascii=False)


CLAIM = (
    "struct<material: string, property: string, experiment_id: string, sample: string, process: string, temperature_c: string, duration_h: string, effect_direction: string, effect_value: string, "
    "effect_unit: string, result_value: string, result_unit: string, lab: string, team: string, equipment: string, quote: string, confidence: string, "
    "entities: array<struct<type: string, name: string>>, relations: array<struct<subject: string, predicate: string, object: string>>, "
    "numeric_parameters: array<struct<name: string, value: double, value_min: double, value_max: double, unit: string, raw_text: string>>>"
)
NUMBERS = ("temperature_c", "duration_h", "effect_value", "result_value")
NAMES = ("material", "property", "experiment_id", "sample", "process", "lab", "team", "equipment")


def route(text: Column, kind: Column, has_image: Column) -> Column:
    """How a window is read: vision for scans, full for tables and for text with numbers, light for the rest."""
    return F.when(has_image, "vision").when((kind == "table") | text.rlike(r"\p{Nd}"), "full").otherwise("light")


def prompts(windows: DataFrame, template: str, terms: str = "", least: int = 40, most: int = 8000) -> DataFrame:
    """windows (window_id, text, section, kind) with prompt; windows under `least` characters are not sent, longer texts are cut at `most`."""
    prompt = F.lit(template)
    for name, value in (("section", F.coalesce(F.nullif(F.col("section"), F.lit("")), F.lit("не указан"))), ("canonical_terms", F.lit(terms)), ("fragment_text", F.substring("text", 1, most))):
        prompt = F.replace(prompt, F.lit("{" + name + "}"), value)
    return windows.where(F.length("text") >= least).withColumn("prompt", prompt)


def term_list(synonyms: DataFrame, most: int = 40) -> DataFrame:
    """synonyms (position, canonical, type) -> type, terms: the first distinct names of each type, joined."""
    first = synonyms.groupBy("type", "canonical").agg(F.min("position").alias("p"))
    lists = first.groupBy("type").agg(F.slice(F.array_sort(F.collect_list(F.struct("p", "canonical"))), 1, most).alias("cs"))
    return lists.select("type", F.array_join(F.transform("cs", lambda c: c["canonical"]), ", ").alias("terms"))


def call(rows: DataFrame, model: Callable[[], ChatModel] = lambda: offline_model, id_col: str = "window_id") -> DataFrame:
    """id, answer: the model's answer to each prompt. `model` makes the client, once in each task; a failed call leaves its answer null."""
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = model()
        for pdf in batches:
            answers = []
            for prompt in pdf["prompt"]:
                try:
                    answers.append(client(prompt))
                except Exception:  # the window stays, unanswered
                    answers.append(None)
            yield pd.DataFrame({id_col: pdf[id_col], "answer": answers})

    return rows.select(id_col, "prompt").mapInPandas(run, f"`{id_col}` {kind}, answer string")


def claims(answers: DataFrame, id_col: str = "window_id") -> DataFrame:
    """id, claim_no, payload, quote, confidence of each usable claim.

    Missing names are "не указано"; a claim without material and property is dropped; numbers that can't be read are null; an unknown direction is
    unknown; confidence is between 0 and 1, 0.5 if not given.
    """
    body = F.from_json(tx.json_object_in(F.col("answer")), f"claims array<{CLAIM}>")["claims"]
    rows = answers.select(id_col, F.posexplode(body).alias("claim_no", "c")).where("c is not null")
    name = lambda f: F.when(tx.strip(F.coalesce(F.col(f"c.{f}"), F.lit(""))) == "", F.lit("не указано")).otherwise(F.col(f"c.{f}"))
    way = F.when(F.col("c.effect_direction").isin("increase", "decrease", "neutral"), F.col("c.effect_direction")).otherwise("unknown")
    lists = [F.coalesce(F.col(f"c.{f}"), F.array()).alias(f) for f in ("entities", "relations", "numeric_parameters")]
    payload = F.struct(*[name(f).alias(f) for f in NAMES], *[tx.number_or_null(F.col(f"c.{f}")).alias(f) for f in NUMBERS], way.alias("effect_direction"), F.col("c.effect_unit").alias("effect_unit"), F.col("c.result_unit").alias("result_unit"), *lists)
    stated = tx.number_or_null(F.col("c.confidence"))
    sure = F.when(stated.isNull(), 0.5).otherwise(F.least(F.greatest(stated, F.lit(0.0)), F.lit(1.0)))
    kept = rows.where((name("material") != "не указано") | (name("property") != "не указано"))
    return kept.select(id_col, "claim_no", payload.alias("payload"), F.col("c.quote").alias("quote"), sure.alias("confidence"))


def teaser(answer: Column) -> Column:
    """struct<teaser, question> of a "did you know" answer, or null if it is not one."""
    got = F.from_json(tx.json_object_in(answer), "teaser string, question string")
    line = F.regexp_replace(F.trim(F.coalesce(got["teaser"], F.lit(""))), r"^\.\.\.(?=что)", "…")
    ask = F.trim(F.coalesce(got["question"], F.lit("")))
    return F.when(line.startswith("…что") & (ask != ""), F.struct(line.alias("teaser"), ask.alias("question")))
