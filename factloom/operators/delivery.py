"""Exports: triples and their shapes, Markdown, JSON lines, packages with hashes."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def triples(rows: DataFrame, subject: str, predicates: dict[str, Column]) -> DataFrame:
    """(s, p, o) of each row's predicates; nulls are dropped."""
    listed = [F.when(c.isNotNull(), F.struct(F.lit(p).alias("p"), c.cast("string").alias("o"))) for p, c in predicates.items()]
    return rows.select(F.col(subject).cast("string").alias("s"), F.explode(F.array_compact(F.array(*listed))).alias("t")).select("s", "t.p", "t.o")


def shape_violations(facts: DataFrame, required: list[str]) -> DataFrame:
    """Subjects that lack a required predicate: (s, p)."""
    have = facts.where(F.col("p").isin(*required)).select("s", "p").distinct()
    want = facts.select("s").distinct().select("s", F.explode(F.array(*[F.lit(p) for p in required])).alias("p"))
    return want.join(have, ["s", "p"], "left_anti")


def markdown_cell(x: Column) -> Column:
    return F.replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"\r?\n", "<br>"), F.lit("|"), F.lit("\\|"))


def markdown(blocks: DataFrame, document: str, order: str) -> DataFrame:
    """(document, markdown): headings, items, rows and paragraphs of each document's blocks in order."""
    k, x = F.col("kind"), F.col("text")
    line = F.when(k == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), x)).when(k == "list", F.concat(F.lit("- "), x)).when(k == "table", F.concat(F.lit("| "), markdown_cell(x), F.lit(" |"))).otherwise(x)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), line.alias("l")))), lambda s: s["l"]), "\n\n")
    return blocks.groupBy(document).agg(whole.alias("markdown"))


def with_manifest(rows: DataFrame, key: str, body: Column) -> DataFrame:
    """(key, bytes, sha256) of the canonical body of each row: what a package lists."""
    return rows.select(key, F.octet_length(body).cast("long").alias("bytes"), F.sha2(body, 256).alias("sha256"))


def verified(files: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """files (key, sha256) against a manifest: ok, changed, missing or unlisted."""
    f, m = files.select(key, F.col("sha256").alias("have")), manifest.select(key, F.col("sha256").alias("want"))
    return f.join(m, key, "full").select(key, F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unlisted").when(F.col("have") == F.col("want"), "ok").otherwise("changed").alias("verdict"))


#: Suffixes and the formats they stand for.
SUFFIXES = {"pdf": "pdf", "html": "html", "htm": "html", "xhtml": "html", "xlsx": "xlsx", "xlsm": "xlsx", "xls": "ole", "docx": "docx"}


@F.pandas_udf(T.StringType())
def _archive(content: pd.Series) -> pd.Series:
    """What an archive holds, by its members: xlsx, docx, or zip."""

    def kind(raw) -> str | None:
        try:
            with zipfile.ZipFile(io.BytesIO(bytes(raw))) as z:
                names = set(z.namelist())
        except (zipfile.BadZipFile, TypeError):
            return None
        return "xlsx" if "xl/workbook.xml" in names else "docx" if "word/document.xml" in names else "zip"

    return pd.Series([kind(x) for x in content], dtype=object)


def format_of(name: Column, declared: Column, content: Column) -> Column:
    """The format of a file: that of its first bytes, and of its members where it is an archive. mismatch:X where the format declared for it, or else that of its name, is
    X and its bytes are of another; unsupported:X where no reader takes it."""
    starts = lambda mark: F.substring(content, 1, len(mark)) == F.lit(mark)
    head = F.lower(F.substring(content, 1, 512).cast("string"))
    sniffed = F.when(starts(b"%PDF"), "pdf").when(starts(b"PK"), _archive(F.when(starts(b"PK"), content))).when(starts(bytes.fromhex("d0cf11e0")), "ole").when(head.rlike(r"^\s*(<!doctype html|<html)"), "html")
    suffix = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    known = F.element_at(F.create_map(*[F.lit(v) for kv in SUFFIXES.items() for v in kv]), suffix)
    want = F.coalesce(F.lower(declared), known)
    return F.when(sniffed.isNull() | (sniffed == "zip"), F.concat(F.lit("unsupported:"), F.coalesce(sniffed, suffix))).when(want.isNotNull() & (want != sniffed), F.concat(F.lit("mismatch:"), want)).otherwise(sniffed)


def _sorted(column: Column, kind: T.DataType) -> Column:
    """A struct, and those inside it, with fields in the order of their names."""
    if not isinstance(kind, T.StructType):
        return column
    return F.struct(*[_sorted(column[f.name], f.dataType).alias(f.name) for f in sorted(kind, key=lambda f: f.name)])


def indexed(rows: DataFrame, path: str, record: str) -> DataFrame:
    """(path, json, bytes, sha256): each record as compact JSON with sorted keys, and its entry in the artifact index."""
    text = F.to_json(_sorted(F.col(record), rows.schema[record].dataType))
    return rows.select(path, text.alias("json")).select(path, "json", F.octet_length("json").cast("long").alias("bytes"), F.sha2("json", 256).alias("sha256"))


def write_package(rows: DataFrame, key: str, body: str, root: str, actor: str = "export") -> None:
    """Payload, manifest and history below root, the history last: a package without it is not whole."""
    rows.write.parquet(f"{root}/payload")
    with_manifest(rows, key, F.col(body)).write.parquet(f"{root}/manifest")
    files = rows.sparkSession.read.parquet(f"{root}/manifest")
    files.agg(F.count("*").alias("files"), F.lit(actor).alias("actor")).write.json(f"{root}/history")


def read_package(spark: SparkSession, root: str, schema: str, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Payload, manifest (key, bytes, sha256) and history of a package."""
    kind = schema.split(f"{key} ")[1].split(",")[0]
    return spark.read.schema(schema).parquet(f"{root}/payload"), spark.read.schema(f"{key} {kind}, bytes bigint, sha256 string").parquet(f"{root}/manifest"), spark.read.schema("files bigint, actor string").json(f"{root}/history")


def publish(status: DataFrame, root: str, revision: int) -> None:
    """One status row under its revision; Spark's commit makes it appear whole or not at all."""
    status.write.json(f"{root}/revision={revision}")


def published(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """The newest status row with its revision."""
    return spark.read.schema(T.StructType([*schema, T.StructField("revision", T.IntegerType())])).json(root).orderBy(F.desc("revision")).limit(1)
