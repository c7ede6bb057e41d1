"""The record table: schema, readers and adapters that give other tables its shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TEXT = ["source", "kind", "name", "full_path", "docs", "signature", "module", "file"]
_OPTIONAL = ["id", "owner", "crate", "source_ref", "doc_version", "title", "defaults", "heading", "version", "from_version", "to_version", "description", "code", "file_abs"]
EXAMPLE = "struct<lang:string,code:string,compile_fail:boolean,ignored:boolean,scraped:boolean,source_file:string>"

def input_schema() -> str:
    scalar = ", ".join(f"`{c}` string" for c in _TEXT + _OPTIONAL)
    lists = ", ".join(f"{c} array<string>" for c in ("breadcrumb", "categories", "required_features"))
    return f"{scalar}, pr long, line_start long, line_count long, draft boolean, examples array<{EXAMPLE}>, {lists}, _corrupt_record string"


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """Records of a line-JSON file; blank lines are skipped, a malformed line fails the query and is quoted."""
    raw = spark.read.schema(input_schema()).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    checked = F.when(F.col("_corrupt_record").isNotNull(), F.raise_error(F.concat(F.lit("malformed line: "), F.col("_corrupt_record")))).cast("string")
    return with_defaults(raw.withColumn("_bad", checked).where("_bad IS NULL").drop("_bad", "_corrupt_record"))


def with_defaults(raw: DataFrame) -> DataFrame:
    """Absent text is '', absent lists are empty, absent flags false; ``crate`` becomes crate_name."""
    out = raw.withColumns({c: F.coalesce(c, F.lit("")) for c in _TEXT})
    out = out.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("breadcrumb", "categories", "required_features")})
    out = out.withColumn("draft", F.coalesce("draft", F.lit(False))).withColumn("examples", F.coalesce("examples", F.array().cast(f"array<{EXAMPLE}>")))
    return out.withColumnRenamed("crate", "crate_name")


def record_id(version_scoped: tuple[str, ...] = ("rustdoc", "examples")) -> Column:
    """16 hex digits of SHA-1 over source, kind, path, name, heading and, for some sources, version."""
    scope = F.when(F.col("source").isin(*version_scoped), F.coalesce("doc_version", F.lit(""))).otherwise(F.lit(""))
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("source", "kind", "full_path", "name", "heading")]
    return F.substring(F.sha1(F.concat_ws("|", *parts, scope)), 1, 16)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("dense_id"), F.lit("documents").alias("source"), F.col("lang").alias("kind"), F.concat(F.lit("doc"), "doc_id").alias("name"), F.col("text").alias("docs"), F.col("source").alias("module"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    name = F.regexp_replace(F.initcap("p_name"), " ", "")
    return p.select(
        F.col("p_partkey").alias("dense_id"), F.lit("rustdoc").alias("source"), F.lower(F.regexp_replace("p_type", " ", "_")).alias("kind"), name.alias("name"),
        F.col("p_brand").alias("owner"), F.lit("part").alias("module"), F.lit("part").alias("crate_name"), F.concat("p_brand", F.lit("::"), name).alias("full_path"),
        F.concat(F.lit("fn "), name, F.lit("(size: "), F.col("p_size").cast("string"), F.lit(")")).alias("signature"), F.col("p_name").alias("docs"),
    )


PARTS_SQL = """(SELECT p_partkey AS dense_id, 'rustdoc' AS source, lower(replace(p_type, ' ', '_')) AS kind,
  array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), '') AS name,
  p_brand AS owner, 'part' AS module,
  p_brand || '::' || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), '') AS full_path,
  'fn ' || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), '') || '(size: ' || p_size || ')' AS signature,
  p_name AS docs FROM part)"""
