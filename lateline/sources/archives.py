"""ZIP archives of daily files as a Spark data source: one partition per member, filters on members before any is opened."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..schema import RAW_HEADERS
from .actuals import _open, null_cells

SCHEMA = "archive string, member string, header string, line_no bigint, line string, error string"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
BATCH = 10_000            # lines in a batch at most


class Member(InputPartition):
    """A member of an archive; ``error`` where the archive itself cannot be read."""

    def __init__(self, archive: str, name: str | None, error: str | None = None):
        self.archive, self.name, self.error = archive, name, error


def _place(path: str):
    """(file system, path in it, what precedes it in a URI); ``file:`` and plain paths are the same thing."""
    from pyarrow import fs

    if "://" in path and not path.startswith("file:"):
        return *fs.FileSystem.from_uri(path), re.match(r"\w+://[^/]*", path).group(0)
    return fs.LocalFileSystem(), re.sub("^file:/*", "/", path), ""


def put_bytes(path: str, data: bytes) -> None:
    system, inner, _ = _place(path)
    with system.open_output_stream(inner) as out:
        out.write(data)


def archives_below(path: str) -> list[str]:
    """Archives in a folder, or the one named."""
    from pyarrow import fs

    system, inner, prefix = _place(path)
    info = system.get_file_info(inner)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(inner))
    return sorted(prefix + f.path for f in found if f.is_file and f.path.endswith(".zip"))


class ZippedLines(DataSource):
    """``spark.read.format("zipped_lines").load(folder)``: the lines of all CSV members of all archives.

    The planning process reads the archives' directories and makes one partition per member; a task reads its member as a stream.
    ``header`` is the member's first line, lines are numbered from 1 after it. What cannot be read becomes one row with an
    ``error``, after the lines that could.
    """

    @classmethod
    def name(cls) -> str:
        return "zipped_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ZippedReader(self.options["path"])


class ZippedReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality and IN on archive and member choose partitions; Spark applies what is left."""
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column in ("archive", "member"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted.get(column, values) & values
            else:
                yield f

    def partitions(self) -> Sequence[Member]:
        out = []
        for archive in archives_below(self.path):
            if archive not in self.wanted.get("archive", {archive}):
                continue
            try:
                with _open(archive) as z:
                    names = sorted(n for n in z.namelist() if n.endswith(".csv"))
                out += [Member(archive, n) for n in names if n in self.wanted.get("member", {n})]
            except (zipfile.BadZipFile, OSError, ValueError) as e:      # a store's file may refuse the places a ZIP is looked for at
                if "member" not in self.wanted:
                    out.append(Member(archive, None, str(e)))
        return out or [Member("", None)]

    def read(self, member: Member) -> Iterator[pa.RecordBatch]:
        if member.error is not None:
            yield _batch(member, None, 0, [None], member.error)
        if member.name is None:
            return
        header, done, block = None, 0, []
        try:
            with _open(member.archive) as z, z.open(member.name) as raw:
                for line in io.TextIOWrapper(raw, encoding="utf-8-sig", errors="replace"):
                    if header is None:
                        header = line.rstrip("\r\n")
                        continue
                    block.append(line.rstrip("\r\n"))
                    if len(block) >= BATCH:
                        yield _batch(member, header, done, block)
                        done, block = done + len(block), []
        except (NotImplementedError, zipfile.BadZipFile, RuntimeError, OSError, EOFError) as e:
            yield _batch(member, header, done, block)
            yield _batch(member, header, done + len(block), [None], f"{type(e).__name__}: {e}")
            return
        yield _batch(member, header, done, block)


def _batch(member: Member, header, start: int, lines: list, error: str | None = None) -> pa.RecordBatch:
    n = len(lines)
    text = lambda x: pa.array([x] * n, pa.string())
    return pa.RecordBatch.from_arrays(
        [text(member.archive), text(member.name), text(header), pa.array(range(start + 1, start + 1 + n), pa.int64()), pa.array(lines, pa.string()), text(error)],
        names=["archive", "member", "header", "line_no", "line", "error"])


def archive_lines(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(ZippedLines)
    spark.conf.set(PUSHDOWN, "true")
    return spark.read.format("zipped_lines").load(path)


def scan_archives(spark: SparkSession, path: str, headers: Sequence[str], *, members: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of all archives below ``path``, cells matched by name, headers translated.

    ``headers`` states the header lines that occur, so nothing is read to find them; a member with another one becomes an error
    row, as do broken members and archives. ``members`` reads these only.
    """
    lines = archive_lines(spark, path)
    if members is not None:
        lines = lines.filter(F.col("member").isin(*members))
    broken, strange = F.col("error").isNotNull(), ~F.col("header").isin(*headers)
    told = F.when(broken, F.col("error")).otherwise(F.concat(F.lit("unknown header: "), "header"))
    errors = lines.filter(broken | (strange & (F.col("line_no") == 1))).select("archive", "member", told.alias("error"))
    # One struct per layout, so that all of them come from one reading; a cell is taken from the line's own.
    parsed, names = {}, []
    for i, h in enumerate(headers):
        cells = [c.strip().strip('"') for c in h.split(";")]
        cells = [RAW_HEADERS.get(c, c) for c in cells]
        names += [c for c in cells if c not in names]
        row = F.from_csv("line", ", ".join(f"`{c}` string" for c in cells), {"sep": ";", "mode": "PERMISSIVE"})
        parsed[f"__l{i}"] = (F.when(F.col("header") == h, row), cells)
    good = lines.filter(~broken & ~strange & (F.col("line") != "")).withColumns({k: c for k, (c, _) in parsed.items()})
    rows = good.select("archive", "member", *[
        F.coalesce(*[F.col(f"{k}.`{n}`") for k, (_, cells) in parsed.items() if n in cells]).alias(n) for n in names])
    return null_cells(rows), errors


def write_archives(df: DataFrame, folder: str, archive: str, member: str) -> DataFrame:
    """Text rows (``archive``, ``member``, line) as ZIP files of CSV members, one task per archive; returns the names written.

    An archive's lines are streamed into its members in their order, so a task holds one batch of them."""
    def write(batches):
        system, inner, _ = _place(folder)
        system.create_dir(inner, recursive=True)
        z = out = entry = None
        at, names = (None, None), []
        for b in batches:
            for a, m, line in zip(*(b.column(c).to_pylist() for c in (archive, member, "line"))):
                if (a, m) != at and entry is not None:
                    entry.close()
                if a != at[0]:
                    if z is not None:
                        z.close(), out.close()
                    names.append(a)
                    out = system.open_output_stream(posixpath.join(inner, a))
                    z = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                if (a, m) != at:
                    entry, at = z.open(m, "w"), (a, m)
                entry.write((line + "\n").encode())
        if z is not None:
            entry.close(), z.close(), out.close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["archive"])

    dealt = df.repartition(archive).sortWithinPartitions(archive, member, "place")
    return dealt.select(archive, member, "line").mapInArrow(write, "archive string")
