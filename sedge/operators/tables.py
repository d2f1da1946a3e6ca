"""Store semantics as whole-table results: upserts, manifests, versions, scoped deletes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(stored: DataFrame, incoming: DataFrame, key: list[str], order: list[Column] | None = None) -> DataFrame:
    """stored with incoming rows in the place of those of equal keys (null equals null); of several incoming rows of a key the first in order."""
    own = latest(incoming.select(stored.columns), key, *(order or [F.col(c) for c in stored.columns]))
    return _without(stored, own, key).unionByName(own)


def _without(rows: DataFrame, others: DataFrame, key: list[str]) -> DataFrame:
    """rows whose key is not among the others', nulls being equal."""
    o = others.select(*(F.col(k).alias(f"_{k}") for k in key)).distinct()
    return rows.join(o, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key)), "left_anti")


def replace_manifest(stored: DataFrame, incoming: DataFrame, scope: Column, key: list[str], order: list[Column] | None = None) -> DataFrame:
    """Rows out of scope stay; in scope, what incoming lacks goes and the rest is upserted by key."""
    inside = F.coalesce(scope, F.lit(False))
    return stored.where(~inside).unionByName(latest(incoming.where(inside).select(stored.columns), key, *(order or [F.col(c) for c in stored.columns])))


def latest(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def compare_and_set(stored: DataFrame, changes: DataFrame, key: list[str], version: str, value: str) -> DataFrame:
    """Stored rows; a change (key, expected, new) applies where the version is as expected, which rises by 1.

    Of several changes of a key that expect the stored version, the first by value applies; the others come too late.
    """
    one = latest(changes.join(stored.select(*key, F.col(version).alias("_v")), key).where(F.col("_v") == F.col("expected")).drop("_v"), key, F.col("new"))
    joined = stored.join(one, key, "left")
    hit = F.col("expected").isNotNull()
    return joined.select(*key, F.when(hit, F.col(version) + 1).otherwise(F.col(version)).alias(version), F.when(hit, F.col("new")).otherwise(F.col(value)).alias(value), hit.alias("applied"))


def plan_diff(planned: DataFrame, stored: DataFrame, key: list[str], digest: str) -> DataFrame:
    """key and state of each planned row: missing, conflicting or complete. Of several stored rows of a key, one that agrees with the plan counts."""
    there = stored.select(*key, F.col(digest).alias("_there"), F.lit(True).alias("_is"))
    same = F.max(F.col("_there").eqNullSafe(F.col(digest))).alias("_same")
    met = planned.join(there, key, "left").groupBy(*key, digest).agg(same, F.max("_is").alias("_is"))
    state = F.when(F.col("_is").isNull(), "missing").when(F.col("_same"), "complete").otherwise("conflicting")
    return met.select(*key, state.alias("state"))


def scoped(rows: DataFrame, tenant: Column, tenant_is, corpus: Column, corpus_is, trust: Column, trusted: list[str]) -> DataFrame:
    return rows.where((tenant == tenant_is) & (corpus == corpus_is) & trust.isin(trusted))


def without(rows: DataFrame, gone: DataFrame, key: list[str], scope: Column | None = None) -> DataFrame:
    """rows less those whose key is in gone; with a scope, only rows inside it can go."""
    left = _without(rows if scope is None else rows.where(F.coalesce(scope, F.lit(False))), gone, key)
    return left if scope is None else left.unionByName(rows.where(~F.coalesce(scope, F.lit(False))))


def missing_only(stored: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """stored and the first incoming row of each key that it lacks."""
    own = latest(incoming.select(stored.columns), key, *(F.col(c) for c in stored.columns))
    return stored.unionByName(_without(own, stored, key))


def filled_upsert(stored: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Upsert in which a null of the incoming row leaves the stored value."""
    rest = [c for c in stored.columns if c not in key]
    new = latest(incoming.select(stored.columns), key, *(F.col(c) for c in stored.columns)).select(*key, *(F.col(c).alias(f"_{c}") for c in rest))
    return stored.join(new, key, "full").select(*key, *(F.coalesce(f"_{c}", c).alias(c) for c in rest))


def checked_vectors(rows: DataFrame, vector: str, dimension: int) -> DataFrame:
    """rows whose vectors have the dimension; one that has not fails the job."""
    wrong = F.concat(F.lit("a vector has dimension "), F.size(vector).cast("string"))
    return rows.withColumn(vector, F.when(F.size(vector) == dimension, F.col(vector)).otherwise(F.raise_error(wrong)))


def constraint(columns: list[str], asked: list[tuple]) -> Column:
    """All of the (field, operator, value) constraints on known fields, as one condition; without any, true."""

    def of(field: str, operator: str, value) -> Column:
        c = F.col(field)
        return {"eq": lambda: c == value, "contains": lambda: c.startswith(value), "in": lambda: c.isin(value), "not": lambda: c != value}[operator]()

    return reduce(lambda a, b: a & b, (of(*x) for x in asked if x[0] in columns), F.lit(True))


def manifest_rows(arrays: DataFrame, json_col: str, schema: str) -> DataFrame:
    """The rows of JSON arrays, as ``schema``. An array that does not fit it fails; a null one has no rows."""
    return arrays.select(F.explode(F.from_json(json_col, f"array<struct<{', '.join(':'.join(c.split()) for c in schema.split(', '))}>>", {"mode": "FAILFAST"})).alias("r")).select("r.*")
