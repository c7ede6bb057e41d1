"""Folders of pages, prose, examples and error guides as records.

A folder is read by Spark's binary source, recursively, from any store; file names, sizes and depths are filtered before
anything is decoded. What is made of (path, text) is apart from the reading, so that tables of texts can take the same way.
Every file becomes its rows alone, so a folder of any number of files is dealt by its files.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from . import markdown as M
from .html import indexable

EXCLUDED = ("foundation", "donate", "sponsorship")
#: Folders below the root that examples are looked for in.
DEPTH = 6


def read_tree(spark: SparkSession, root: str, glob: str, keep: Column | None = None) -> DataFrame:
    """path (below ``root``), file, size, text of the files whose name fits ``glob``; ``keep`` is asked before the contents are decoded.
    A root that isn't there has no files."""
    from ..storage import Files

    if not Files(spark).exists(root):
        return spark.createDataFrame([], "path string, file string, size long, text string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    start = re.sub(r"^[a-z0-9]+:/*", "/", root).rstrip("/") + "/"
    whole = F.regexp_replace("path", r"^[a-z0-9]+:/+", "/")
    rows = files.select(F.col("path").alias("file"), F.substr(whole, F.lit(len(start) + 1)).alias("path"), F.col("length").alias("size"), "content")
    if keep is not None:
        rows = rows.where(keep)
    return rows.select("path", "file", "size", F.decode("content", "UTF-8").alias("text"))


def html_pages(spark: SparkSession, root: str) -> DataFrame:
    """Pages below a folder, in no source or lock folder, without listings and huge indexes."""
    noise = F.exists(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1), lambda d: d.isin("src", ".lock")) & (F.size(F.split("path", "/")) > 1)
    return read_tree(spark, root, "*.html", ~noise & indexable(F.concat(F.lit("/"), "path"), F.col("size")))


def folder_of(path: str) -> Column:
    """The folder of a path as a::b; '' at the top."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, 1, F.size(parts) - 1), "::")


def stem(path: str) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def website_records(files: DataFrame, doc_version: str | None = None, key: str = "path") -> DataFrame:
    """Records of Markdown files (path, text; ``key`` tells them apart): one a chunk, or the whole page where it has one chunk or none. Pages of kinds in
    ``EXCLUDED`` and pages without a body are left out. A title is the path's, else the page's long or short one, else the file's name."""
    f = files.select(F.col(key).alias("_key"), "path", M.classify("path").alias("c"), M.front_matter("text").alias("m"))
    f = f.where(~F.col("c.kind").isin(*EXCLUDED) & (F.regexp_replace("m.body", r"\s", "") != "")).withColumn("body", F.col("m.body"))
    chunks = M.chunks(f, "_key", "body").select("_key", "section", "line_start", "heading", "breadcrumb", F.col("text").alias("docs"))
    title = F.coalesce("c.title", "m.long_title", "m.title", stem("path"))
    info = f.select(
        "_key", F.lit("website").alias("source"), F.col("c.kind").alias("kind"), title.alias("name"), F.concat_ws(":", "c.kind", "path").alias("full_path"), folder_of("path").alias("module"), F.col("path").alias("file"), title.alias("title"),
        (F.coalesce(F.col("m.status") == "hidden", F.lit(False)) | F.col("m.draft")).alias("draft"), F.col("c.version").alias("version"), F.col("c.from_version").alias("from_version"), F.col("c.to_version").alias("to_version"), F.col("c.pr").alias("pr"),
    )
    return chunks.join(info, "_key").withColumns({"signature": F.lit(""), "crate_name": F.lit("website"), "doc_version": F.lit(doc_version).cast("string")}).drop("_key")


def example_records(files: DataFrame, source: str, doc_version: str | None = None) -> DataFrame:
    """Records of source examples (path, text): the code with its leading comment as description, and tags of its path."""
    doc = M.module_doc("text")
    fenced = F.concat(F.lit("```rust\n"), "text", F.lit("\n```"))
    module = F.when(folder_of("path") == "", ".").otherwise(folder_of("path"))
    deep = F.size(F.split("path", "/")) - 1
    return files.where(deep <= DEPTH).select(
        F.lit(source).alias("source"), F.lit("code_example").alias("kind"), stem("path").alias("name"), F.concat(F.lit(f"{source}:"), "path").alias("full_path"), F.lit(source).alias("crate_name"), module.alias("module"), F.lit("").alias("signature"),
        F.when(doc == "", fenced).otherwise(F.concat(doc, F.lit("\n\n"), fenced)).alias("docs"), F.nullif(doc, F.lit("")).alias("description"), F.col("text").alias("code"), F.col("path").alias("file"),
        F.size(F.split("text", "\n", -1)).cast("long").alias("line_count"), M.categorise("path").alias("categories"), stem("path").alias("title"), F.lit(doc_version).cast("string").alias("doc_version"),
    )


def error_code_records(folders: list[DataFrame], prefix: str, doc_version: str | None = None) -> DataFrame:
    """Records of error guides, of the first folder (path, text) that has any: files right in it whose names are a code's."""
    guides = [f.where(X.is_error_page(F.col("path"))) for f in folders]
    chosen = next((g for g in guides if not g.isEmpty()), guides[-1])
    name = F.substring_index("path", ".", 1)
    return chosen.select(
        F.lit("meta").alias("source"), F.lit("error_code").alias("kind"), name.alias("name"), F.concat(F.lit(f"{prefix}::errors::"), name).alias("full_path"), F.col("text").alias("docs"), F.lit("").alias("signature"),
        F.lit(f"{prefix}::errors").alias("module"), F.concat(F.lit("errors/"), "path").alias("file"), F.concat(F.lit("Error "), name).alias("title"), F.lit(doc_version).cast("string").alias("doc_version"),
    )


def plugin_gates(sources: DataFrame, key: str, text: str) -> DataFrame:
    """key, ord, requires_feature, plugin: plugins that source text lists under a feature's condition, in order of appearance."""
    shape = r'(?s)#\[cfg\(feature\s*=\s*"([^"]+)"\)\]\s*\n(?:\s*#\[[^\]]*\]\s*\n)*\s*[A-Za-z0-9_:]+::([A-Za-z0-9_]+)'
    found = F.arrays_zip(F.regexp_extract_all(F.col(text), F.lit(shape), F.lit(1)).alias("feature"), F.regexp_extract_all(F.col(text), F.lit(shape), F.lit(2)).alias("plugin"))
    return sources.select(key, F.posexplode(found).alias("ord", "g")).select(key, "ord", F.col("g.feature").alias("requires_feature"), "g.plugin")


def panic_sites(sources: DataFrame, key: str, text: str) -> DataFrame:
    """key, code, line (from 1) of every error[Bnnnn] or warning[Bnnnn] in source text."""
    lines = sources.select(key, F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "line")).where(F.col("line").rlike(r"(error|warning)\[B\d{4}\]"))
    return lines.select(key, (F.col("pos") + 1).alias("line"), F.explode(F.regexp_extract_all("line", F.lit(r"(error|warning)\[(B\d{4})\]"), F.lit(2))).alias("code"))


def corpora(spark: SparkSession, requested: list[tuple[str, str]], root: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Records of the corpora asked for (name, version), and a row for each with what became of it.

    A corpus lies in ``root/<name>/<version>`` as Parquet. First: ``columns``, corpus, version of all that can be read. Second: corpus,
    version, state (read or skipped), reason: null, ``missing``, ``wrong format`` (columns that lack), or ``unreadable`` with the reader's
    message. A file cut short doesn't fail the others. The requests are a caller's short list."""
    from ..storage import Files

    files, frames, states = Files(spark), [], []
    for name, version in requested:
        path = f"{root}/{name}/{version}"
        reason = None
        if not files.exists(path):
            reason = "missing"
        else:
            try:
                rows = spark.read.parquet(path)
                lacking = [c for c in columns if c not in rows.columns]
                if lacking:
                    reason = f"wrong format: no {', '.join(lacking)}"
                else:
                    rows.select(*columns).agg(F.count(F.lit(1))).collect()  # the footers of all files
                    frames.append(rows.select(F.lit(name).alias("corpus"), F.lit(version).alias("version"), *columns))
            except Exception as e:  # whatever the reader says becomes the reason
                reason = f"unreadable: {str(e).splitlines()[0][:200]}"
        states.append((name, version, "read" if reason is None else "skipped", reason))
    states_ = spark.createDataFrame(states, "corpus string, version string, state string, reason string")
    if not frames:
        return spark.createDataFrame([], "corpus string, version string, " + ", ".join(f"{c} string" for c in columns)), states_
    return reduce(DataFrame.unionByName, frames), states_


def detected(candidates: DataFrame) -> DataFrame:
    """source, version, crates, ambiguous: of each source of (name, version) candidates its one version, or none where they differ, with all
    distinct candidates by name and version."""
    from ..functions import versions as V

    distinct = candidates.select("source", "name", "version").distinct()
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", V.core("version").alias("c"), "version"))), lambda x: F.concat_ws(" ", x["name"], x["version"])), ", ")
    out = distinct.groupBy("source").agg(F.count_distinct("version").alias("n"), F.min("version").alias("version"), listed.alias("crates"))
    return out.select("source", F.when(F.col("n") == 1, F.col("version")).alias("version"), "crates", (F.col("n") > 1).alias("ambiguous"))
