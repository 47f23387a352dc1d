"""Reading tables of many formats into DataFrames, and coercing them to a template."""

from __future__ import annotations

import bz2
import gzip
import io
import json
import lzma

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweave.sources.formats import BY_EXTENSION, Format, available, detect

TRUE, FALSE = ("TRUE", "T", "1", "YES"), ("FALSE", "F", "0", "NO")


def _listed(spark: SparkSession, path: str) -> list[str] | None:
    """Files of a directory in sorted order; None if the path is a file (or a Spark directory of one format)."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise FileNotFoundError(path)
    if not fs.getFileStatus(p).isDirectory():
        return None
    return sorted(s.getPath().toString() for s in fs.listStatus(p) if s.isFile())


def _bytes(spark: SparkSession, path: str, packed: str | None = None) -> bytes:
    """A single file's content (formats that only local libraries read; one file at a time)."""
    data = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    return {"xz": lzma.decompress, "gzip": gzip.decompress, "bzip2": bz2.decompress}[packed](data) if packed else data


def read_data(spark: SparkSession, path: str, format: str | None = None, template: DataFrame | None = None, sheet: int | str = 0, **options) -> DataFrame:
    """A table from a file, a Spark directory, or a directory of recognised files (others are ignored)."""
    files = _listed(spark, path)
    if files is not None:
        data = [f for f in files if not f.rsplit("/", 1)[-1].startswith(("_", "."))]
        if format is None and "." not in path.rstrip("/").rsplit("/", 1)[-1]:
            known = [f for f in data if any(part in BY_EXTENSION for part in f.rsplit("/", 1)[-1].lower().split(".")[1:])]
            if not known:
                raise ValueError(f"no recognised file in {path}")
            out = None
            for name in {detect(f)[0].name: None for f in known}:  # one scan a format
                part = _read(spark, [f for f in known if detect(f)[0].name == name], *detect(next(f for f in known if detect(f)[0].name == name)), sheet, options)
                out = part if out is None else out.unionByName(part)
            return match_types(out, template) if template is not None else out
        f, packed = detect(path, format)
        paths = [path] if f.name in ("csv", "tsv", "json", "ndjson", "parquet") else data
    else:
        f, packed = detect(path, format)
        paths = [path]
    out = _read(spark, paths, f, packed, sheet, options)
    return match_types(out, template) if template is not None else out


def _read(spark: SparkSession, paths: list[str], f: Format, packed: str | None, sheet, options: dict) -> DataFrame:
    if not f.read or not available(f):
        raise RuntimeError(f"{f.name} files cannot be read here" + (f": {f.needs} is needed" if f.needs else ""))
    if f.name in ("csv", "tsv"):
        reader = spark.read.options(header=True, inferSchema=True, nullValue="NA", quote='"', escape='"', sep="\t" if f.name == "tsv" else ",", **options)
        if packed == "xz":  # Spark has no codec for it
            import pandas as pd

            frames = [pd.read_csv(io.BytesIO(_bytes(spark, p, packed)), sep="\t" if f.name == "tsv" else ",", na_values=["NA", ""], keep_default_na=False) for p in paths]
            return spark.createDataFrame(pd.concat(frames, ignore_index=True))
        df = reader.csv(paths)
        return df.select(*[F.nullif(F.col(f"`{c}`"), F.lit("")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes])
    if f.name in ("json", "ndjson"):
        if packed == "xz":
            text = [_bytes(spark, p, packed).decode() for p in paths]
            rows = [r for t in text for r in (json.loads(t) if f.name == "json" else map(json.loads, filter(None, t.splitlines())))]
            return spark.createDataFrame(rows)
        lines, whole = [], []
        for p in paths:
            (lines if f.name == "ndjson" or _line_delimited(spark, p) else whole).append(p)
        out = None
        for part, multi in ((lines, False), (whole, True)):
            if part:
                df = spark.read.options(**options).json(part, multiLine=multi)
                out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        return out
    if f.name == "parquet":
        return spark.read.options(**options).parquet(*paths)
    import pandas as pd

    out = None
    for p in paths:
        data = io.BytesIO(_bytes(spark, p))
        if f.name == "feather":
            import pyarrow as pa
            import pyarrow.feather

            table = pyarrow.feather.read_table(data)
            part = spark.createDataFrame(table if isinstance(table, pa.Table) else pa.table(table))
        elif f.name == "stata":
            frame = pd.read_stata(data)
            part = spark.createDataFrame(frame.apply(lambda s: s.astype(object).where(s.notna(), None) if s.dtype.name == "category" else s))
        elif f.name in ("sas", "xpt"):
            frame = pd.read_sas(data, format="xport" if f.name == "xpt" else "sas7bdat", encoding="utf-8")
            part = spark.createDataFrame(frame)
        elif f.name == "excel":
            part = spark.createDataFrame(pd.read_excel(data, sheet_name=sheet))
        elif f.name == "hdf5":
            import h5py

            with h5py.File(data, "r") as h:
                group = h[options.get("dataset", "data")]
                columns = {k: group[k][...] for k in group} if hasattr(group, "keys") else {f"V{k + 1}": c for k, c in enumerate(group[...].T.reshape(-1, len(group)))}
            if len({len(v) for v in columns.values()}) > 1:
                raise ValueError("HDF5 columns have unequal lengths")
            part = spark.createDataFrame(pd.DataFrame(columns))
        else:
            import os
            import tempfile

            import pyreadstat

            with tempfile.TemporaryDirectory() as folder:  # the library reads paths of the driver only
                at = os.path.join(folder, "table." + p.rsplit(".", 1)[-1].lower())
                with open(at, "wb") as file:
                    file.write(data.getvalue())
                part = spark.createDataFrame((pyreadstat.read_por if at.endswith("por") else pyreadstat.read_sav)(at, apply_value_formats=True)[0])
        part = part.select(*[F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in part.dtypes])
        out = part if out is None else out.unionByName(part)
    return out


def _line_delimited(spark: SparkSession, path: str) -> bool:
    """Whether a .json file or directory holds one object a line instead of arrays: its first line with
    content is a whole object.  (A reader of whole documents would take only the first of such lines.)"""
    first = spark.read.text(path).filter(F.trim("value") != "").select(F.trim("value").alias("v")).first()
    if first is None or not first["v"].startswith("{"):
        return False
    try:
        json.loads(first["v"])
    except json.JSONDecodeError:
        return False
    return True


# The shapes of a time, longest first; what follows the matched part is ignored.
DATE = r"^([0-9]{4})([-/])([0-9]{1,2})\2([0-9]{1,2})"
CLOCK = r"[ \t]+([0-9]{1,2}):([0-9]{1,2})"
SECONDS = r":([0-9]{1,2}(?:\.[0-9]*)?)"
OFFSET = r"(?<=[0-9])([+-])([0-9]{2}):?([0-9]{2})$"


def parse_datetime(c: Column, zone: str = "UTC") -> Column:
    """A time from text in any of several shapes, mixed within a column: dates with - or /, alone or with hours and
    minutes, seconds, or fractions of these, after a blank or T.  Z and offsets are honoured, others are local to
    ``zone``.  A clock that is out of range leaves the shorter shape; text without a date gives NULL."""
    text = F.trim(F.regexp_replace(F.trim(c), "^([^T]*)T", "$1 "))
    utc, shifted = text.endswith("Z"), text.rlike(r"[0-9]([+-])([0-9]{2}):?([0-9]{2})$") & text.rlike(":")
    body = F.when(utc, F.regexp_replace(text, "Z$", "")).when(shifted, F.regexp_replace(text, OFFSET, "")).otherwise(text)
    minutes = F.regexp_extract(text, OFFSET, 2).try_cast("int") * 60 + F.regexp_extract(text, OFFSET, 3).try_cast("int")
    shift = F.when(shifted & ~utc, F.when(F.regexp_extract(text, OFFSET, 1) == "-", -minutes).otherwise(minutes)).otherwise(0)

    def part(pattern: str, group: int, kind: str = "int") -> Column:
        return F.nullif(F.regexp_extract(body, pattern, group), F.lit("")).try_cast(kind)

    day = [part(DATE, g) for g in (1, 3, 4)]
    place = F.when(utc | shifted, "UTC").otherwise(zone)
    zero = F.lit(0)

    def made(hour: Column, minute: Column, second: Column) -> Column:
        return F.try_make_timestamp(*day, hour, minute, second.cast("decimal(16,6)"), place)

    clock = part(DATE + CLOCK, 5), part(DATE + CLOCK, 6)
    found = F.coalesce(made(*clock, part(DATE + CLOCK + SECONDS, 7, "decimal(16,6)")), made(*clock, zero), made(zero, zero, zero))
    return F.timestamp_micros(F.unix_micros(found) - shift.cast("long") * 60_000_000)


def to_boolean(c: Column) -> Column:
    t = F.upper(F.trim(c.cast("string")))
    return F.when(t.isin(*TRUE), True).when(t.isin(*FALSE), False)


def to_levels(c: Column, levels: list[str]) -> Column:
    """Labels as they are, whole numbers 1..K as codes where no label is a number, anything else NULL."""
    text = c.cast("string")
    known = F.when(text.isin(*levels), text)
    if any(v.strip().lstrip("-").isdigit() for v in levels):
        return known
    code = text.try_cast("double")
    return F.coalesce(known, F.try_element_at(F.array(*[F.lit(v) for v in levels]), F.when((code == F.floor(code)) & code.between(1, len(levels)), code.cast("int"))))


def match_types(df: DataFrame, template: DataFrame, zone: str = "UTC") -> DataFrame:
    """``df`` with the column types of ``template``; values that do not fit become NULL, other columns stay."""
    out = []
    for c in df.columns:
        if c not in template.columns:
            out.append(F.col(c))
            continue
        field, x = template.schema[c], F.col(c)
        kind, meta = field.dataType, field.metadata or {}
        source = df.schema[c].dataType
        if "levels" in meta:
            y = to_levels(x, list(meta["levels"]))
        elif source == kind:
            y = x
        elif isinstance(kind, T.BooleanType):
            y = to_boolean(x)
        elif isinstance(kind, T.IntegralType):
            y = x.try_cast("double").cast("decimal(38,6)").cast(kind) if isinstance(source, T.StringType) else x.try_cast(kind)
        elif isinstance(kind, T.DateType):
            y = F.date_from_unix_date(x.cast("int")) if isinstance(source, T.NumericType) else F.to_date(F.try_to_timestamp(F.substring(x.cast("string"), 1, 10), F.lit("yyyy-MM-dd")))
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            y = (F.timestamp_micros((x * 1_000_000).cast("long")) if isinstance(source, T.NumericType) else parse_datetime(x.cast("string"), zone)).cast(kind)
        else:
            y = x.try_cast(kind)
        out.append(y.alias(c, metadata=meta))
    return df.select(*out)
