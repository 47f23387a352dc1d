"""Writing tables; Spark formats as directories, the others as single files of bounded tables."""

from __future__ import annotations

import io
import re
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweave.sources.formats import available, detect
from tabweave.sources.workspace import exists, put

# Names that Stata reserves.
RESERVED = frozenset("_all _b byte _coef _cons double float if in int long _n _N _pi _pred _rc _skip strL using with".split())
SINGLE_FILE_ROWS = 5_000_000


def stata_names(names: list[str]) -> list[str]:
    """Valid, unique Stata names: other characters to _, no leading digit, at most 32, reserved words marked."""
    out: list[str] = []
    for n in names:
        s = re.sub(r"[^A-Za-z0-9_]", "_", n) or "_"
        s = ("v" + s if s[0].isdigit() else s)[:32]
        s = s + "_" if s in RESERVED or re.fullmatch(r"str[0-9]+", s) else s
        base, k = s, 1
        while s in out:
            k += 1
            s = f"{base[: 31 - len(str(k))]}_{k}"
        out.append(s)
    if out != names:
        warnings.warn("renamed for Stata: " + ", ".join(f"{a} -> {b}" for a, b in zip(names, out) if a != b), stacklevel=2)
    return out


def iso_times(df: DataFrame) -> DataFrame:
    """Times as ISO-8601 text in UTC, with the fraction of a second where there is one."""
    def iso(c: str):
        kind = df.schema[c].dataType
        if not isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return F.col(c)
        t = F.col(c) if isinstance(kind, T.TimestampNTZType) else F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col(c).cast("timestamp_ntz"))
        whole = F.date_trunc("second", t).cast("timestamp_ntz") == t
        return F.when(whole, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias(c)

    return df.select(*[iso(c) for c in df.columns])


def json_arrays(df: DataFrame) -> DataFrame:
    """One text column: every partition's rows as the lines of one JSON array, so that each file is a whole document."""

    def run(batches):
        import pyarrow as pa

        first = True
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([(f"[{x}" if first and not i else f",{x}") for i, x in enumerate(b[0].to_pylist())])], names=["value"])
                first = False
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if first else "]"])], names=["value"])

    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("value")).mapInArrow(run, "value string")


def write_data(df: DataFrame, path: str, format: str | None = None, overwrite: bool = True, append: bool = False, **options) -> str:
    """Write ``df`` and return the path.  Text formats and Parquet are written by all tasks into a
    directory; formats of one file hold at most SINGLE_FILE_ROWS rows, which pass the driver, and are
    written where ``path`` says, also on a shared file system."""
    f, packed = detect(path, format)
    if not f.write or not available(f, "write"):
        hint = "; xpt, csv or parquet can be written instead" if f.name == "sas" else ""
        raise RuntimeError(f"{f.name} files cannot be written here" + (f": {f.needs_to('write')} is needed" if f.needs_to("write") else "") + hint)
    writer = df.write if f.name == "parquet" else (json_arrays(iso_times(df)) if f.name == "json" else iso_times(df)).write
    writer = writer.mode("append" if append else "overwrite" if overwrite else "errorifexists").options(**options)
    if packed == "xz":
        raise RuntimeError("xz cannot be written here; gzip and bzip2 can")
    if packed:
        writer = writer.option("compression", packed)
    if f.name in ("csv", "tsv"):
        writer.option("header", True).option("escape", '"').option("nullValue", "").option("sep", "\t" if f.name == "tsv" else ",").csv(path)
    elif f.name == "json":
        writer.text(path)
    elif f.name == "ndjson":
        writer.option("ignoreNullFields", False).json(path)
    elif f.name == "parquet":
        writer.parquet(path)
    else:
        spark = df.sparkSession
        if exists(spark, path) and not overwrite:
            raise FileExistsError(path)
        if df.limit(SINGLE_FILE_ROWS + 1).count() > SINGLE_FILE_ROWS:
            raise ValueError(f"{f.name} is for at most {SINGLE_FILE_ROWS} rows; write parquet instead")
        put(spark, path, _single_file(df, f.name, path))
    return path


def _single_file(df: DataFrame, name: str, path: str) -> bytes:
    """The content of a file of a format that holds one table (of a checked size)."""
    import os
    import tempfile

    out = io.BytesIO()
    if name == "feather":
        import pyarrow.feather

        pyarrow.feather.write_feather(df.toArrow(), out)
    elif name == "stata":
        bools = [F.col(c).cast("int").alias(c) if t == "boolean" else F.col(c) for c, t in df.dtypes]
        df.select(*bools).toDF(*stata_names(df.columns)).toPandas().to_stata(out, write_index=False, version=118)
    elif name == "excel":
        if path.lower().endswith(".xls"):
            raise ValueError(".xls cannot be written; use .xlsx")
        df.toPandas().to_excel(out, index=False)
    elif name == "hdf5":
        import h5py

        with h5py.File(out, "w") as h:
            for c, x in df.toPandas().items():
                h.create_dataset(f"data/{c}", data=x.to_numpy())
    else:  # spss, xpt: the library writes to a path of the driver only
        import pyreadstat

        with tempfile.TemporaryDirectory() as folder:
            at = os.path.join(folder, "table")
            (pyreadstat.write_sav if name == "spss" else pyreadstat.write_xport)(df.toPandas(), at)
            with open(at, "rb") as file:
                return file.read()
    return out.getvalue()


def generate_to_file(model, spark: SparkSession, n: int, path: str, format: str | None = None, chunk_size: int = 100_000, seed: int = 1, **settings) -> dict:
    """Generate ``n`` rows straight into files of at most ``chunk_size`` rows; ids are unique over all files."""
    from tabweave.operators.synthesizer import generate

    if chunk_size < 1:
        raise ValueError("chunk_size must be at least 1")
    f, _ = detect(path, format)
    parts = max(1, -(-n // chunk_size))
    rows = generate(model, spark, n, seed, partitions=parts, **settings)
    if f.name in ("csv", "tsv", "json", "ndjson", "parquet"):
        write_data(rows, path, format, maxRecordsPerFile=chunk_size)
    else:
        write_data(rows, path, format)
    return {"path": path, "format": f.name, "n": n, "chunks": parts}
