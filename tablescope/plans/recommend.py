"""Recommend a modelling task, target, models and use cases from column roles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import fold_nan, is_numeric, is_text, quoted, rounded_value
from ..operators.profile import DATE_FORMATS, maybe_date
from ..operators.value_counts import counted, distinct_counts, families
from ..session import local_table
from .rules import DEFAULT_USE_CASES, DOMAIN_PARTS, MODELS, TARGET_PARTS, USE_CASES

ROLES = ("dataset_id string, position int, name string, role string, unique_count bigint, avg_length double, rows bigint")


def _text_facts(df: DataFrame, text: list[str], digest: bool) -> dict[str, dict]:
    """Per text column: distinct values, mean length, and whether one single date layout reads every value (the
    layouts are tried on distinct values only; on all where texts are counted by digest)."""
    [(_, long)] = families(df, text)
    layouts = [F.col("maybe").try_cast("timestamp").isNotNull(), *[F.try_to_timestamp("maybe", F.lit(f)).isNotNull() for f in DATE_FORMATS]]
    maybe = F.when(maybe_date(F.col("value")), F.col("value"))
    totals = [F.count("*").alias("count"), F.sum(F.length("value").cast("bigint")).alias("length")]
    if digest:
        tried = [F.bool_and(c).alias(f"d{i}") for i, c in enumerate(layouts)]
        keys = long.withColumn("maybe", maybe).groupBy("column", counted(F.col("value"), "string", True).alias("key")).agg(*totals, *tried)
        layouts = [F.col(f"d{i}") for i in range(len(layouts))]
    else:
        keys = long.groupBy("column", "value").agg(*totals).withColumn("maybe", maybe)
    rows = keys.groupBy("column").agg(
        F.count("*").alias("unique_count"), (F.sum("length") / F.sum("count").cast("double")).alias("avg_length"),
        reduce(lambda a, b: a | b, [F.bool_and(c) for c in layouts]).alias("dated"))
    return {r["column"]: r.asDict() for r in rows.collect()}      # one row per column


def text_facts(df: DataFrame, digest: bool = False) -> dict[str, dict]:
    """Facts of all text columns, learnt in one job."""
    df = fold_nan(df)
    text = [f.name for f in df.schema.fields if is_text(f)]
    return _text_facts(df, text, digest) if text else {}


def column_roles(df: DataFrame, dataset_id: str = "table", uniques: dict[str, int] | None = None, rows: int | None = None,
                 facts: dict[str, dict] | None = None) -> DataFrame:
    """(dataset_id, position, name, role, unique_count, avg_length, rows).

    Roles: boolean, numeric, datetime, text, low_cardinality, other. Distinct
    counts, row count and text facts that are already known can be passed in.
    """
    df = fold_nan(df)
    rows = df.count() if rows is None else rows
    facts = text_facts(df) if facts is None else facts
    numeric = [f.name for f in df.schema.fields if is_numeric(f)]
    if uniques is None:
        uniques = {r["column"]: r["unique_count"] for r in distinct_counts(df, numeric).collect()} if numeric else {}
    out = []
    for i, f in enumerate(df.schema.fields):
        got = facts.get(f.name, {})
        unique, length = got.get("unique_count", uniques.get(f.name, 0)), got.get("avg_length")
        if isinstance(f.dataType, T.BooleanType):
            role = "boolean"
        elif is_numeric(f):
            role = "numeric"
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)) or got.get("dated"):
            role = "datetime"
        elif not is_text(f):
            role = "other"
        elif (length or 0) > 50:
            role = "text"
        elif unique <= 20 or (unique <= 50 and rows and unique / rows < 0.1):
            role = "low_cardinality"
        else:
            role = "other"
        out.append({"dataset_id": dataset_id, "position": i, "name": f.name, "role": role, "unique_count": unique,
                    "avg_length": rounded_value(length, 4), "rows": rows})
    return local_table(df.sparkSession, out, ROLES)


def _any_part(name: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(name, F.lit(p)) for p in parts])


def detect_domain(columns: DataFrame) -> DataFrame:
    """(dataset_id, domain) from a (dataset_id, position, name) table; '' when nothing matches."""
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", F.lower("name").alias("n")))),
                                     lambda s: s["n"]), " ")
    hits = lambda parts: reduce(lambda a, b: a + b, [F.contains(F.col("names"), F.lit(p)).cast("int") for p in parts])
    scored = F.array(*[F.struct(hits(parts).alias("score"), F.lit(-i).alias("first"), F.lit(d).alias("domain"))
                       for i, (d, parts) in enumerate(DOMAIN_PARTS.items())])
    best = columns.groupBy("dataset_id").agg(names.alias("names")).select("dataset_id", F.array_max(scored).alias("best"))
    return best.select("dataset_id", F.when(F.col("best.score") > 0, F.col("best.domain")).otherwise("").alias("domain"))


def detect_target(roles: DataFrame) -> DataFrame:
    """(dataset_id, target, is_categorical, classes); tables without a target are left out."""
    low = F.col("role") == "low_cardinality"
    number = F.col("role") == "numeric"
    hint = _any_part(F.lower("name"), TARGET_PARTS)
    last = F.col("position") == F.col("last")
    choice = F.when(low & hint, 1).when(number & hint, 2).when(last & (low | number), 3)
    ends = roles.groupBy("dataset_id").agg(F.max("position").alias("last"))
    best = (
        roles.join(ends, "dataset_id").withColumn("choice", choice).where(F.col("choice").isNotNull())
        .groupBy("dataset_id").agg(F.min(F.struct("choice", "position", "name", "role", "unique_count")).alias("b"))
    )
    categorical = (F.col("b.role") == "low_cardinality") | (F.col("b.unique_count") <= 10)
    return best.select("dataset_id", F.col("b.name").alias("target"), categorical.alias("is_categorical"),
                       F.col("b.unique_count").alias("classes"))


def pick_time_target(roles: DataFrame) -> DataFrame:
    """(dataset_id, target): the rightmost numeric column."""
    return roles.where(F.col("role") == "numeric").groupBy("dataset_id").agg(F.max_by("name", "position").alias("target"))


def _names(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def class_models(classes: Column) -> Column:
    return (F.when(classes == 2, _names(MODELS["two classes"])).when(classes <= 10, _names(MODELS["few classes"]))
            .otherwise(_names(MODELS["many classes"])))


def use_cases(task: Column, domain: Column, most: int = 5) -> Column:
    """Cases of the domain for the task, then the general ones, at most five."""
    merged = {}
    for t, domains in USE_CASES.items():
        for d, cases in {**domains, "": []}.items():
            merged[f"{t}|{d}"] = list(dict.fromkeys(cases + domains["general"]))[:most]
    table = F.create_map(*[x for key, cases in merged.items() for x in (F.lit(key), _names(cases))])
    return F.coalesce(table[F.concat_ws("|", task, domain)], table[F.concat(task, F.lit("|"))])


def recommend(roles: DataFrame) -> DataFrame:
    """(dataset_id, task, confidence, models, target, reasoning, use_cases), one row per table."""
    listed = lambda role, most: F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.when(
        F.col("role") == role, F.struct("position", "name")))), lambda s: s["name"]), 1, most), ", ")
    count = lambda role: F.count(F.when(F.col("role") == role, True))
    first_low = F.min(F.when(F.col("role") == "low_cardinality", F.struct("position", "name")))["name"]
    facts = roles.groupBy("dataset_id").agg(
        count("datetime").alias("dates"), count("text").alias("texts"), count("numeric").alias("numbers"),
        listed("datetime", 100_000).alias("date_names"), listed("text", 3).alias("text_names"), first_low.alias("first_low"))
    joined = (
        facts.join(detect_domain(roles), "dataset_id", "left")
        .join(detect_target(roles), "dataset_id", "left")
        .join(pick_time_target(roles).withColumnRenamed("target", "time_target"), "dataset_id", "left")
    )
    case = (F.when(F.col("dates") > 0, "time").when(F.col("texts") > 0, "text")
            .when(F.col("is_categorical"), "classes").when(F.col("target").isNotNull(), "number")
            .when(F.col("numbers") >= 3, "groups").otherwise("unknown"))
    pick = lambda options, default: reduce(lambda acc, kv: F.when(F.col("case") == kv[0], kv[1]).otherwise(acc), options.items(), default)
    out = joined.withColumn("case", case)
    task = pick({"time": F.lit("time-series"), "number": F.lit("regression"), "groups": F.lit("clustering")}, F.lit("classification"))
    target = pick({"time": F.col("time_target"), "text": F.col("first_low"), "classes": F.col("target"), "number": F.col("target")},
                  F.lit(None).cast("string"))
    domain = F.when((F.col("case") == "text") & (F.col("domain") == ""), F.lit("text")).otherwise(F.col("domain"))
    models = pick({"time": _names(MODELS["time-series"]), "text": _names(MODELS["text"]), "classes": class_models(F.col("classes")),
                   "number": _names(MODELS["regression"]), "groups": _names(MODELS["clustering"])}, _names(MODELS["unknown"]))
    count_text = F.col("classes").cast("string")
    why = pick({
        "time": F.concat(F.lit("Time columns: "), F.col("date_names"), F.lit(".")),
        "text": F.concat(F.lit("Long text columns: "), F.col("text_names"), F.lit(".")),
        "classes": F.concat(F.col("target"), F.lit(" has "), count_text, F.lit(" classes.")),
        "number": F.concat(F.col("target"), F.lit(" is a number with "), count_text, F.lit(" values.")),
        "groups": F.lit("No target stands out among several numeric columns."),
    }, F.lit("No task stands out; name a target column."))
    confidence = pick({"time": F.lit(85), "text": F.lit(78), "classes": F.lit(88), "number": F.lit(85), "groups": F.lit(60)}, F.lit(40))
    cases = F.when(F.col("case") == "unknown", _names(DEFAULT_USE_CASES)).otherwise(use_cases(task, domain))
    return out.select("dataset_id", task.alias("task"), confidence.alias("confidence"), models.alias("models"),
                      target.alias("target"), why.alias("reasoning"), cases.alias("use_cases"))
