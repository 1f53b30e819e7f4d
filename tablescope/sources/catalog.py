"""Raw listing records (JSON text) to catalogue rows, one source each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import format_bytes, slug_title, stable_id

CATALOG = ("id string, title string, description string, source string, format string, size string, size_bytes bigint, "
           "download_url string, tags array<string>, last_updated string, author string, license string")

KAGGLE = ("ref string, title string, subtitle string, description string, totalBytes bigint, lastUpdated string, tags array<string>, "
          "licenseName string")
HUGGINGFACE = ("id string, description string, cardData struct<description:string,license:string>, tags array<string>, "
               "lastModified string, downloads bigint")
GITHUB = ("full_name string, name string, description string, size bigint, topics array<string>, updated_at string, "
          "owner struct<login:string>, license struct<spdx_id:string>, stargazers_count bigint, html_url string")


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _list(c: str, most: int | None = None) -> Column:
    tags = F.coalesce(F.col(c), F.array().cast("array<string>"))
    return F.slice(tags, 1, most) if most else tags


def _filled(c: str, other: Column) -> Column:
    return F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c)).otherwise(other)


def _start(text: Column, chars: int | None) -> Column:
    return text if chars is None else F.substring(text, 1, chars)


def _upto(r: DataFrame, size: Column, max_bytes: int | None) -> DataFrame:
    return r if max_bytes is None else r.where(size <= max_bytes)


def _parsed(raw: DataFrame, column: str, ddl: str) -> DataFrame:
    return raw.select(F.from_json(F.col(column), ddl).alias("r")).select("r.*")


def normalize_kaggle(raw: DataFrame, column: str = "record", max_bytes: int | None = None) -> DataFrame:
    r = _parsed(raw, column, KAGGLE)
    size = F.coalesce(F.col("totalBytes"), F.lit(0).cast("bigint"))
    author = F.when(F.contains("ref", F.lit("/")), F.element_at(F.split("ref", "/"), 1)).otherwise("Unknown")
    return _upto(r, size, max_bytes).select(
        stable_id("kaggle", F.col("ref")).alias("id"), F.coalesce("title", "ref").alias("title"),
        _filled("subtitle", _text("description")).alias("description"), F.lit("kaggle").alias("source"), F.lit("csv").alias("format"),
        format_bytes(size).alias("size"), size.alias("size_bytes"), F.col("ref").alias("download_url"), _list("tags").alias("tags"),
        _text("lastUpdated").alias("last_updated"), author.alias("author"), _filled("licenseName", F.lit("Unknown")).alias("license"))


def normalize_huggingface(raw: DataFrame, column: str = "record", description_chars: int | None = None, max_tags: int | None = None) -> DataFrame:
    """Descriptions and tags are whole unless a width is given."""
    r = _parsed(raw, column, HUGGINGFACE)
    slash = F.contains("id", F.lit("/"))
    text = _filled("description", F.coalesce(F.col("cardData.description"), F.lit("")))
    return r.select(
        stable_id("hf", F.col("id")).alias("id"), F.when(slash, slug_title(F.col("id"))).otherwise(F.col("id")).alias("title"),
        _start(text, description_chars).alias("description"), F.lit("huggingface").alias("source"), F.lit("csv").alias("format"),
        F.concat(F.format_number(F.coalesce("downloads", F.lit(0).cast("bigint")), 0), F.lit(" downloads")).alias("size"),
        F.lit(0).cast("bigint").alias("size_bytes"), F.concat(F.lit("https://huggingface.co/datasets/"), "id").alias("download_url"),
        _list("tags", max_tags).alias("tags"), _text("lastModified").alias("last_updated"),
        F.when(slash, F.element_at(F.split("id", "/"), 1)).otherwise("HuggingFace").alias("author"),
        F.coalesce(F.col("cardData.license"), F.lit("Unknown")).alias("license"))


def normalize_github(raw: DataFrame, column: str = "record", max_bytes: int | None = None, description_chars: int | None = None,
                     max_tags: int | None = None) -> DataFrame:
    """Descriptions and tags are whole, and no record is left out, unless a limit is given."""
    r = _parsed(raw, column, GITHUB)
    size = (F.coalesce(F.col("size"), F.lit(0).cast("bigint")) * 1024).cast("bigint")
    return _upto(r, size, max_bytes).select(
        stable_id("gh", F.col("full_name")).alias("id"), slug_title(F.coalesce("name", "full_name")).alias("title"),
        _start(_text("description"), description_chars).alias("description"), F.lit("github").alias("source"), F.lit("csv").alias("format"),
        format_bytes(size, smallest="KB").alias("size"), size.alias("size_bytes"),
        F.coalesce(F.col("html_url"), F.concat(F.lit("https://github.com/"), "full_name")).alias("download_url"),
        _list("topics", max_tags).alias("tags"), _text("updated_at").alias("last_updated"),
        F.coalesce(F.col("owner.login"), F.lit("Unknown")).alias("author"),
        F.coalesce(F.col("license.spdx_id"), F.lit("Unknown")).alias("license"))


def union_catalogs(*catalogs: DataFrame) -> DataFrame:
    """All sources in one catalogue; columns only some of them have become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), catalogs)
