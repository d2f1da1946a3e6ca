"""Documents from text files and pages. Files are read by Spark in parallel, one row a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of a page that are not its content, and elements that hold it, the first found being taken.
DROPPED = ("script", "style", "nav", "footer", "header", "aside")
HOLDERS = ("article", "main", "body")


def text_files(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("txt", "md")) -> DataFrame:
    """source, type, title, text of each file in a folder: text trimmed, blank files left out.

    A Markdown file's first heading of level 1 is its title, else the file's name.
    """
    raw = spark.read.option("pathGlobFilter", f"*.{{{','.join(extensions)}}}").text(path, wholetext=True)
    name = F.col("_metadata.file_name")
    rows = raw.select(name.alias("source"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("type"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("text"))
    heading = F.when(F.col("type") == "md", F.nullif(F.trim(F.regexp_extract("text", r"(?m)^#[ \t]+(.+)$", 1)), F.lit("")))
    return rows.where("text != ''").select("source", "type", F.coalesce(heading, F.col("source")).alias("title"), "text")


def page_text(html: Column) -> Column:
    """A page's readable text: DROPPED elements and comments go, then tags; white space is one space."""
    for tag in DROPPED:
        html = F.regexp_replace(html, f"(?is)<{tag}\\b[^>]*>.*?</{tag}>", " ")
    html = F.regexp_replace(html, "(?s)<!--.*?-->", " ")
    held = [F.nullif(F.regexp_extract(html, f"(?is)<{tag}\\b[^>]*>(.*?)</{tag}>", 1), F.lit("")) for tag in HOLDERS]
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(*held, html), "(?s)<[^>]*>", " "), r"[ \t\r\n\f]+", " "))


def json_records(spark: SparkSession, path: str, schema) -> DataFrame:
    """Records of JSON files with a stated schema; a record that does not fit it fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def markdown_tables(rows: DataFrame, sheet: str, columns: list[str], order: str) -> DataFrame:
    """sheet, text: a heading and a Markdown table for each sheet, its rows in order. A sheet is one text, so it is as large as that."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), F.lit(" |"))
    head = F.concat(F.lit("## "), F.col(sheet).cast("string"), F.lit("\n| " + " | ".join(columns) + " |\n| " + " | ".join("---" for _ in columns) + " |\n"))
    listed = rows.groupBy(sheet).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))).alias("l"))
    return listed.select(sheet, F.concat(head, F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("text")).withColumnRenamed(sheet, "sheet")


#: Extensions by format, in the order in which they are tried.
FORMATS = (("text", "txt|text"), ("markdown", "md|markdown"), ("sheet", "xlsx|xls|csv"), ("json", "json"), ("pdf", "pdf"), ("docx", "docx"), ("pptx", "pptx"))


def format_of(name: Column) -> Column:
    """How a source is read: by its address, else by its extension, else as raw text."""
    out = F.when(name.rlike(r"^https?://(www\.)?(youtube\.com|youtu\.be)/"), "youtube").when(name.rlike("^https?://"), "url")
    for kind, extensions in FORMATS:
        out = out.when(F.lower(name).rlike(rf"\.({extensions})$"), kind)
    return out.otherwise("raw")
