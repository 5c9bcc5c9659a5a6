"""Stage plumbing: keyword construction, and saving of stages that own tables or other stages."""

from __future__ import annotations

from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter,
)
from pyspark.sql import DataFrame


def param(name: str, doc: str, convert=TypeConverters.identity) -> Param:
    return Param(Params._dummy(), name, doc, typeConverter=convert)


def strings(name: str, doc: str) -> Param:
    return param(name, doc, TypeConverters.toListString)


def string(name: str, doc: str) -> Param:
    return param(name, doc, TypeConverters.toString)


def floats(name: str, doc: str) -> Param:
    return param(name, doc, TypeConverters.toListFloat)


def number(name: str, doc: str) -> Param:
    return param(name, doc, TypeConverters.toFloat)


def integer(name: str, doc: str) -> Param:
    return param(name, doc, TypeConverters.toInt)


def boolean(name: str, doc: str) -> Param:
    return param(name, doc, TypeConverters.toBoolean)


class Keywords(Params):
    """``Stage(a=1, b=2)`` sets params a and b; class attribute ``defaults`` gives the rest."""

    defaults: dict = {}

    def __init__(self, **kw):
        super().__init__()
        self._setDefault(**self.defaults)
        self._set(**{k: v for k, v in kw.items() if v is not None})

    def __getitem__(self, name: str):
        return self.getOrDefault(name)

    def has(self, name: str) -> bool:
        return self.isDefined(self.getParam(name))


class Saved(MLReadable, MLWritable):
    """Params plus ``tables`` (name → DataFrame) and ``parts`` (name → stage or list of stages)."""

    tables: dict[str, DataFrame]
    parts: dict

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)

    def owning(self, tables: dict | None = None, parts: dict | None = None):
        self.tables = tables or {}
        self.parts = parts or {}
        return self


class _Writer(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        tables = getattr(self.instance, "tables", {})
        parts = getattr(self.instance, "parts", {})
        shape = {n: (len(p) if isinstance(p, list) else -1) for n, p in parts.items()}
        DefaultParamsWriter.saveMetadata(
            self.instance, path, self.sparkSession, extraMetadata={"tables": list(tables), "parts": shape})
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{path}/tables/{name}")
        for name, part in parts.items():
            for i, stage in enumerate(part if isinstance(part, list) else [part]):
                stage.write().overwrite().save(f"{path}/parts/{name}/{i}")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        spark = self.sparkSession
        meta = DefaultParamsReader.loadMetadata(path, spark)
        out = self.cls()
        out._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(out, meta)
        tables = {n: spark.read.parquet(f"{path}/tables/{n}") for n in meta["tables"]}
        parts = {}
        for name, n in meta["parts"].items():
            stages = [DefaultParamsReader.loadParamsInstance(f"{path}/parts/{name}/{i}", spark) for i in range(abs(n))]
            parts[name] = stages if n >= 0 else stages[0]
        return out.owning(tables, parts)
