"""Evaluation datasets read strictly: each case from JSON, errors with their path, and gold evidence that must be in the corpus."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CASES = "id string, query string, tags array<string>, gold array<struct<evidence:string,relevance:int>>, abstain boolean, path string, error string"


class _Wrong(Exception):
    def __init__(self, path: str, message: str):
        self.path, self.message = path, message


def _record(value, path: str) -> dict:
    if not isinstance(value, dict):
        raise _Wrong(path, "must be an object")
    return value


def _array(value, path: str) -> list:
    if not isinstance(value, list):
        raise _Wrong(path, "must be an array")
    return value


def _text(value, path: str) -> str:
    if not isinstance(value, str) or not value.strip():
        raise _Wrong(path, "must be a non-empty string")
    return value


def _decoded(text: str | None, path: str) -> tuple:
    """id, query, tags, gold, abstain of a case; the first thing that is wrong is raised."""
    try:
        value = json.loads(text or "")
    except (ValueError, RecursionError):
        raise _Wrong(path, "must be JSON") from None
    case = _record(value, path)
    abstain = case.get("expectedAbstain")
    if not isinstance(abstain, bool):
        raise _Wrong(f"{path}.expectedAbstain", "must be a boolean")
    gold = []
    for k, one in enumerate(_array(case.get("goldEvidence"), f"{path}.goldEvidence")):
        at = f"{path}.goldEvidence[{k}]"
        own = _record(one, at)
        name, relevance = _text(own.get("evidenceId"), f"{at}.evidenceId"), own.get("relevance")
        if isinstance(relevance, bool) or relevance not in (1, 2, 3):
            raise _Wrong(f"{at}.relevance", "must be one of 1, 2, or 3")
        gold.append({"evidence": name, "relevance": int(relevance)})
    seen: set[str] = set()
    for k, g in enumerate(gold):
        if g["evidence"] in seen:
            raise _Wrong(f"{path}.goldEvidence[{k}].evidenceId", f"duplicate value {g['evidence']}")
        seen.add(g["evidence"])
    if abstain and gold:
        raise _Wrong(f"{path}.goldEvidence", "must be empty when expectedAbstain is true")
    tags = [_text(t, f"{path}.tags[{k}]") for k, t in enumerate(_array(case.get("tags"), f"{path}.tags"))]
    return _text(case.get("id"), f"{path}.id"), _text(case.get("query"), f"{path}.query"), tags, gold, abstain


def decode_cases(rows: DataFrame, at_col: str, json_col: str) -> DataFrame:
    """at and the columns of CASES: each row's case, or the path and message of the first thing that is wrong with it and nulls.

    Paths begin with ``$.cases[at]``. Strings are taken as they are, blank ones are errors; fields that are not known are left out. Null and broken JSON is an error of the case.
    """

    def run(batches):
        for batch in batches:
            out = []
            for at, text in zip(batch["at"], batch["json"]):
                try:
                    out.append((at, *_decoded(text, f"$.cases[{at}]"), None, None))
                except _Wrong as e:
                    out.append((at, None, None, None, None, None, e.path, e.message))
            yield pd.DataFrame(out, columns=["at", *(c.split()[0] for c in CASES.split(", "))])

    thin = rows.select(F.col(at_col).cast("long").alias("at"), F.col(json_col).alias("json"))
    return thin.mapInPandas(run, f"at long, {CASES}")


def dataset_errors(cases: DataFrame, corpus: DataFrame) -> DataFrame:
    """path, error of all that is wrong with a dataset, a row each: what decoding found, ids that cases before had, gold evidence that the corpus (evidence) has not.

    Of cases of one id the first keeps it. Ids and evidence meet by equality, so neither the cases nor the corpus go through one task.
    """
    wrong = cases.where("error IS NOT NULL").select("path", "error")
    fine = cases.where("error IS NULL")
    order = Window.partitionBy("id").orderBy("at")
    again = fine.withColumn("_n", F.row_number().over(order)).where("_n > 1").select(F.format_string("$.cases[%d].id", "at").alias("path"), F.concat(F.lit("duplicate value "), "id").alias("error"))
    gold = fine.select("at", F.posexplode("gold").alias("k", "g")).select("at", "k", F.col("g.evidence").alias("evidence"))
    lost = gold.join(corpus.select("evidence").distinct(), "evidence", "left_anti")
    unknown = lost.select(F.format_string("$.cases[%d].goldEvidence[%d].evidenceId", "at", "k").alias("path"), F.concat(F.lit("references unknown corpus evidence "), "evidence").alias("error"))
    return wrong.unionByName(again).unionByName(unknown)
