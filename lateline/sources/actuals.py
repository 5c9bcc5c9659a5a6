"""Daily actuals: semicolon CSV files, plain or inside monthly archives."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.rows import rename_known
from ..schema import RAW_HEADERS, raw_schema

# Cells that mean "no value".
NULL_CELLS = ("", "NA")


def null_cells(df: DataFrame) -> DataFrame:
    return df.withColumns({
        f.name: F.when(~F.col(f.name).isin(*NULL_CELLS), F.col(f.name))
        for f in df.schema.fields if isinstance(f.dataType, T.StringType)
    })


def csv_layouts(spark: SparkSession, path) -> list[tuple[list[str], list[str]]]:
    """(header line's cells, files that have it): a CSV scan binds cells by position, so each layout needs its own.

    One pass finds the first line of every file; the driver, which lists the files anyway, receives one line per file.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value",
        F.monotonically_increasing_id().alias("at"))
    heads = lines.filter("start = 0").groupBy("file").agg(F.min_by("value", "at").alias("head")).collect()
    found: dict[str, list[str]] = {}
    for r in sorted(heads, key=lambda r: r["file"]):
        found.setdefault(r["head"].lstrip("\ufeff").rstrip("\r"), []).append(r["file"])
    return [([c.strip().strip('"') for c in head.split(";")], files) for head, files in found.items()]


def by_layout(spark: SparkSession, path) -> list[DataFrame]:
    """A lazy all-string scan per header layout; cells that a row lacks are NULL."""
    options = dict(sep=";", header=True, mode="PERMISSIVE", enforceSchema=True)
    return [spark.read.schema(raw_schema(names)).options(**options).csv(files) for names, files in csv_layouts(spark, path)]


def read_actuals(spark: SparkSession, path, headers: list[str] | None = None) -> DataFrame:
    """Splittable scan, every cell a string, headers translated, short rows padded with NULL.

    Columns are matched by name: files are scanned per header layout and united. ``headers`` states the one header that
    all files have and saves the pass that looks for it.
    """
    if headers is not None:
        parts = [spark.read.schema(raw_schema(headers)).options(sep=";", header=True, mode="PERMISSIVE", enforceSchema=True).csv(path)]
    else:
        parts = by_layout(spark, path)
    named = [rename_known(p, RAW_HEADERS) for p in parts]
    out = named[0]
    for p in named[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return null_cells(out)


_MEMBERS = T.StructType([
    T.StructField("archive", T.StringType()), T.StructField("member", T.StringType()),
    T.StructField("header", T.StringType()), T.StructField("error", T.StringType()),
])
_LINES = T.StructType([
    T.StructField("archive", T.StringType()), T.StructField("member", T.StringType()),
    T.StructField("layout", T.LongType()), T.StructField("line_no", T.LongType()), T.StructField("line", T.StringType()),
    T.StructField("error", T.StringType()),
])
_BATCH = 50_000


def _open(path: str) -> zipfile.ZipFile:
    """Archive opened by random access, so neither it nor a member is held in memory."""
    if path.startswith("file:") or "://" not in path:
        return zipfile.ZipFile(re.sub("^file:/*", "/", path))
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return zipfile.ZipFile(system.open_input_file(inner))


def _list_members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path in batch["path"]:
            try:
                with _open(path) as archive:
                    names = sorted(n for n in archive.namelist() if n.endswith(".csv"))
                    for name in names:
                        header, error = None, None
                        try:
                            with archive.open(name) as raw:
                                header = raw.readline().decode("utf-8-sig", "replace").rstrip("\r\n")
                        except (NotImplementedError, zipfile.BadZipFile, RuntimeError) as e:
                            error = str(e)
                        yield pd.DataFrame({"archive": [path], "member": [name], "header": [header], "error": [error]})
            except (zipfile.BadZipFile, OSError) as e:
                yield pd.DataFrame({"archive": [path], "member": [None], "header": [None], "error": [str(e)]})


def _member_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, member in zip(batch["archive"], batch["member"]):
            done, layout = 0, 0
            try:
                with _open(path) as archive, archive.open(member) as raw:
                    block: list[str] = []
                    for line in io.TextIOWrapper(raw, encoding="utf-8-sig", errors="replace"):
                        block.append(line.rstrip("\r\n"))
                        if done == 0 and len(block) == 1:
                            layout = layout_id(block[0])
                        if len(block) >= _BATCH:
                            yield _frame(path, member, layout, done, block, None)
                            done, block = done + len(block), []
                    if block:
                        yield _frame(path, member, layout, done, block, None)
            except (NotImplementedError, zipfile.BadZipFile, RuntimeError, OSError) as e:
                yield _frame(path, member, layout, done, [None], str(e))


def layout_id(header: str) -> int:
    return zlib.crc32(header.encode())


def _frame(archive, member, layout, start, lines, error) -> pd.DataFrame:
    return pd.DataFrame({
        "archive": archive, "member": member, "layout": layout, "line_no": range(start, start + len(lines)),
        "line": lines, "error": error,
    })


def read_archives(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) over all CSV members of all ZIP archives under ``path``.

    Members are listed first and then spread over tasks, so one large archive is read in parallel.
    The lines are parsed by Spark's CSV parser. Run it once as an ingest job and keep the parquet.
    Broken archives and members become error rows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path")
    members = files.mapInPandas(_list_members, _MEMBERS)
    readable = members.filter(F.col("header").isNotNull())
    # One text per file layout, not per file.
    layouts = sorted(r["header"] for r in readable.select("header").distinct().collect())
    spread = readable.select("archive", "member").repartition("archive", "member")
    lines = spread.mapInPandas(_member_lines, _LINES)
    errors = members.filter(F.col("error").isNotNull()).select("archive", "member", "error").unionByName(
        lines.filter(F.col("error").isNotNull()).select("archive", "member", "error"))
    good = lines.filter(F.col("error").isNull() & (F.col("line_no") > 0) & (F.col("line") != ""))
    parsed, names = {}, []
    for i, layout in enumerate(layouts):
        cells = [RAW_HEADERS.get(h.strip(), h.strip()) for h in layout.split(";")]
        names += [n for n in cells if n not in names]
        kind = ", ".join(f"`{n}` string" for n in cells)
        row = F.from_csv("line", kind, {"sep": ";", "mode": "PERMISSIVE"})
        parsed[f"__l{i}"] = (F.when(F.col("layout") == layout_id(layout), row), cells)
    typed = good.withColumns({k: c for k, (c, _) in parsed.items()})
    rows = typed.select("archive", "member", *[
        F.coalesce(*[F.col(f"{k}.`{n}`") for k, (_, cells) in parsed.items() if n in cells]).alias(n) for n in names])
    return null_cells(rows), errors
