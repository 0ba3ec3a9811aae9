"""Corpus files: JSON arrays of entries."""

from __future__ import annotations

import glob
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axiomata.functions.analysis import analyse
from axiomata.functions.strings import not_blank
from axiomata.schema import ENTRY, FORMULA

FIELDS = [f.split()[0] for f in ENTRY.split(", ")]


def expand_home(path: str) -> str:
    """Only ``~`` and ``~/...`` stand for the home folder."""
    return os.path.expanduser(path) if path == "~" or path.startswith("~/") else path


def expand(paths: list[str], spark: SparkSession | None = None) -> list[str]:
    """Sorted files of paths: globs, folders (their ``*.json``, not below), files. A missing path is an error.

    Paths with a scheme, as ``hdfs://``, are looked up where Spark reads, which takes a session.
    """
    found: list[str] = []
    for path in map(expand_home, paths):
        if "://" in path:
            found += _remote(path, spark)
        elif any(c in path for c in "*?["):
            found += glob.glob(path)
        elif os.path.isdir(path):
            found += [os.path.join(path, f) for f in os.listdir(path) if f.endswith(".json")]
        elif os.path.exists(path):
            found.append(path)
        else:
            raise FileNotFoundError(path)
    return sorted(found)


def _remote(path: str, spark: SparkSession | None) -> list[str]:
    if spark is None:
        raise ValueError(f"{path}: a path with a scheme takes a session")
    pattern = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    hits = files.globStatus(pattern) or []
    if not len(hits) and not any(c in path for c in "*?["):
        raise FileNotFoundError(path)
    found: list[str] = []
    for hit in hits:
        if hit.isDirectory():
            found += [f.getPath().toString() for f in files.listStatus(hit.getPath()) if f.isFile() and f.getPath().getName().endswith(".json")]
        else:
            found.append(hit.getPath().toString())
    return found


def sources(paths: list[str], roots: list[str], spark: SparkSession | None = None) -> list[str]:
    """The files to read: given paths, or else the configured roots."""
    if not paths and not roots:
        raise ValueError("no corpus paths given and none configured")
    return expand(paths or roots, spark)


def read_entries(spark: SparkSession, files: list[str]) -> tuple[DataFrame, DataFrame]:
    """(entries with their place, skipped files). A file that isn't an array of entries is skipped whole.

    Files are read as wholes on the executors; ``seq`` orders entries by file and place.
    """
    return entries_of(spark.read.format("binaryFile").load(files))


def entries_of(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same of files that were read as rows (path, content)."""
    raw = files.select("path", F.decode("content", "UTF-8").alias("text"))
    array = F.try_parse_json(F.col("text"))
    items = F.try_variant_get(array, "$", "array<variant>")
    kind = lambda v, f: F.schema_of_variant(F.try_variant_get(v, f"$.{f}", "variant"))
    typed = lambda v: F.forall(F.array(*[F.coalesce(kind(v, f), F.lit("VOID")) for f in FIELDS]), lambda k: k.isin("STRING", "VOID"))
    good = items.isNotNull() & F.forall(items, lambda v: F.schema_of_variant(v).startswith("OBJECT") & typed(v))
    checked = raw.select("path", "text", F.coalesce(good, F.lit(False)).alias("good"))
    rows = checked.where("good").select("path", F.posexplode(F.from_json("text", f"array<struct<{ENTRY}>>")).alias("at", "e"))
    entries = rows.select(F.struct("path", "at").alias("seq"), *[F.coalesce(F.col(f"e.{f}"), F.lit("")).alias(f) for f in FIELDS])
    return entries, checked.where("not good").select("path")


def sides(entries: DataFrame) -> DataFrame:
    """One row per side that isn't blank, lhs before rhs."""
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(s).alias("side"), F.col(s).alias("mma")) for i, s in enumerate(("lhs", "rhs"))]))
    more = [c for c in ("seq",) if c in entries.columns]
    rows = entries.select(*more, F.col("id").alias("entry_id"), "label", "source", "class", "latex", "verified", pairs.alias("s"))
    return rows.select(*more, "entry_id", "s.side", "label", "source", "class", "latex", "s.mma", "verified", "s.pos").where(not_blank(F.col("mma")))


def analysis(rows: DataFrame) -> DataFrame:
    """Sides with all that derives from their text, parsed once; ``error`` is null for those that parse."""
    found = rows.withColumn("a", analyse(F.col("mma")))
    more = [c for c in ("seq", "pos") if c in rows.columns]
    return found.select(*more, *[c for c in FORMULA if c in rows.columns], "a.*")


def parted(analysed_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(formulas, rejected rows with their error)."""
    more = [c for c in ("seq", "pos") if c in analysed_rows.columns]
    good = analysed_rows.where("error is null").select(*more, *FORMULA, "tokens", "facets", "side_latex")
    return good, analysed_rows.where("error is not null").select("entry_id", "side", "mma", "error")


def analysed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(formulas, rejected rows with their error), each text parsed once."""
    return parted(analysis(rows))
