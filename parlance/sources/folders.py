"""Folders of CSV files: columns by name, and a named reason for every file that cannot be read.

Files of one folder may have their columns in any order, and columns that are
not asked for. A first pass over all files together finds each one's header,
its records and its widest record; a file that stops that job is found by
halving the list, so a few bad files among many cost few jobs. The second pass
reads the good files, which differ by the place of their columns only.

A file is set aside when it has no header, lacks a required column, has a record
with more cells than its header, is no UTF-8 text, has over ``MOST_COLUMNS``
columns, or cannot be read at all (a broken archive, say). A record with fewer
cells has nulls for the rest. Of equal column names the first counts.

Files are named by their base name, or by their folder's where that is an
exported table (``x.csv/part-..``), so a large export is one file again.
Multi-line files cannot be split: a file is the unit of parallelism.
"""

from __future__ import annotations

from dataclasses import dataclass
from fnmatch import fnmatch

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_COLUMNS = 200
FILE, POS = "file_name", "file_pos"


@dataclass
class Scan:
    """``rows``: file_name, file_pos and the columns. ``files``: path, file_name, records, error of every file."""

    rows: DataFrame
    files: DataFrame
    errors: dict[str, str]


def logical_name(path: Column) -> Column:
    """Base name of a file, or of its folder where the file is a part of an exported table."""
    # Spark gives paths percent-encoded; a plus sign is itself there.
    path = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    base, folder = F.element_at(F.split(path, "/"), -1), F.try_element_at(F.split(path, "/"), F.lit(-2))
    return F.when(base.startswith("part-") & folder.isNotNull(), folder).otherwise(base)


def csv_reader(spark: SparkSession, width: int, header: bool):
    """Records of up to ``width`` cells as columns c0, c1, ..., whatever the header says."""
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
    return spark.read.schema(schema).option("header", header).option("multiLine", True).option("escape", '"')


def _found(spark: SparkSession, paths: list[str]) -> tuple[list[Row], dict[str, str]]:
    """One row per readable file (its header and sizes), and the errors of the others."""
    if not paths:
        return [], {}
    cells = [F.col(f"c{i}") for i in range(MOST_COLUMNS + 1)]
    width = F.coalesce(*[F.when(c.isNotNull(), F.lit(i + 1)) for i, c in reversed(list(enumerate(cells)))], F.lit(0))
    odd = F.concat_ws("", *cells).contains("\ufffd")
    place = F.monotonically_increasing_id()
    rows = csv_reader(spark, MOST_COLUMNS + 1, False).csv(paths).select(
        F.col("_metadata.file_path").alias("file"), F.array(*cells).alias("cells"), width.alias("width"),
        odd.alias("odd"), place.alias("place"),
    )
    try:
        # A row per file.
        return rows.groupBy("file").agg(
            F.min_by("cells", "place").alias("header"), (F.count("*") - 1).alias("records"), F.max("width").alias("widest"),
            F.max("odd").alias("odd"),
        ).collect(), {}
    except Exception as exc:  # noqa: BLE001 - reported with the file's name
        if len(paths) == 1:
            return [], {paths[0]: f"cannot be read: {type(exc).__name__}"}
    half = len(paths) // 2
    (a, x), (b, y) = _found(spark, paths[:half]), _found(spark, paths[half:])
    return a + b, x | y


def _empty(spark: SparkSession, path: str, glob: str) -> list[str]:
    """Files without a byte, which Spark's sources do not list."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, out = system.listFiles(target, True) if system.exists(target) else None, []
    while found is not None and found.hasNext():
        status = found.next()
        name = status.getPath().getName()
        if not status.getLen() and fnmatch(name, glob) and name[0] not in "._":
            out.append(status.getPath().toString())
    return out


def _is_text(spark: SparkSession, path: str) -> bool:
    content = spark.read.format("binaryFile").load(path).select(F.is_valid_utf8(F.col("content").cast("string")))
    return bool(content.head()[0])


def _reason(spark: SparkSession, path: str, row: Row | None, names: list[str], required: list[str]) -> str | None:
    lacking = [c for c in required if c not in names]
    if row is None or not names:
        return "no header"
    if lacking:
        return f"no column {', '.join(lacking)}"
    if len(names) > MOST_COLUMNS:
        return f"over {MOST_COLUMNS} columns"
    if row["widest"] > len(names):
        return f"a record of {row['widest']} cells under {len(names)} columns"
    if row["odd"] and not _is_text(spark, path):
        return "not UTF-8"
    return None


def _names(header: list[str | None]) -> list[str]:
    names = [(c or "").removeprefix("\ufeff") for c in header]
    while names and not names[-1]:
        names.pop()
    return names


def scan(
    spark: SparkSession, path: str, schema: T.StructType, required: list[str] | None = None, glob: str = "*.csv*"
) -> Scan:
    """The CSV files of a file or folder; ``required`` are the columns that a file must have (all, if not given)."""
    required = schema.names if required is None else required
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    listed = listed.select("path", F.col("_metadata.file_path").alias("file"))
    # Names and headers only.
    paths = {r["file"]: r["path"] for r in listed.collect()}
    rows, unread = _found(spark, sorted(paths.values()))
    rows = {r["file"]: r for r in rows}
    headers = {f: _names(rows[f]["header"]) if f in rows else [] for f in paths}
    errors = {p: unread.get(p) or _reason(spark, p, rows.get(f), headers[f], required) for f, p in paths.items()}
    errors = {p: e for p, e in errors.items() if e}
    empty = _empty(spark, path, glob)
    good = {f: p for f, p in paths.items() if p not in errors}
    kinds: dict[tuple[int, ...], list[str]] = {}
    for f, p in good.items():
        places = tuple(headers[f].index(c) if c in headers[f] else -1 for c in schema.names)
        kinds.setdefault(places, []).append(p)
    out = None
    for places, group in sorted(kinds.items()):
        cells = [
            (F.col(f"c{i}") if i >= 0 else F.lit(None)).cast(field.dataType).alias(field.name)
            for i, field in zip(places, schema.fields)
        ]
        part = csv_reader(spark, max(places) + 1, True).csv(sorted(group)).select(
            logical_name(F.col("_metadata.file_path")).alias(FILE), F.monotonically_increasing_id().alias(POS), *cells
        )
        out = part if out is None else out.unionByName(part)
    shape = T.StructType([T.StructField(FILE, T.StringType()), T.StructField(POS, T.LongType()), *schema.fields])
    out = spark.createDataFrame([], shape) if out is None else out
    errors |= {p: "no header" for p in empty}
    told = [(f, p, rows[f]["records"] if f in rows else None, errors.get(p)) for f, p in sorted(paths.items())]
    told += [(p, p, 0, errors[p]) for p in empty]
    files = spark.createDataFrame(told, "file string, path string, records long, error string")
    return Scan(out, files.select("path", logical_name(F.col("file")).alias(FILE), "records", "error"), errors)
