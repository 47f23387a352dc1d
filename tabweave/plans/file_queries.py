"""Queries of sources and sinks: tables are written by the library, read back by it, and compared with the originals."""

from __future__ import annotations

import lzma

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.operators import synthesizer
from tabweave.plans.registry import drawn_sql, query, table, values
from tabweave.sources import formats, readers, writers
from tabweave.sources.workspace import put, workspace

PART = "SELECT CAST(p_partkey AS BIGINT) AS p_partkey, CASE WHEN p_size % 7 <> 0 THEN p_brand END AS brand, CAST(p_size AS INTEGER) AS p_size, CASE WHEN p_size % 5 <> 0 THEN p_retailprice END AS price, p_size % 2 = 0 AS even FROM part"


def parts(spark, d) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), F.when(F.col("p_size") % 7 != 0, F.col("p_brand")).alias("brand"), F.col("p_size").cast("int").alias("p_size"), F.when(F.col("p_size") % 5 != 0, F.col("p_retailprice")).alias("price"), (F.col("p_size") % 2 == 0).alias("even"))


def back(spark, d, name: str) -> DataFrame:
    df = parts(spark, d)
    return readers.read_data(spark, writers.write_data(df, f"{workspace(spark)}/{name}"), template=df)


@query(PART)
def csv_round_trip(spark, d):
    return back(spark, d, "parts.csv")


@query(PART)
def tsv_round_trip(spark, d):
    return back(spark, d, "parts.tsv")


@query(PART)
def csv_gz_round_trip(spark, d):
    return back(spark, d, "parts.csv.gz")


@query(PART)
def json_round_trip(spark, d):
    return back(spark, d, "parts.json")


@query(PART)
def ndjson_bz2_round_trip(spark, d):
    return back(spark, d, "parts.ndjson.bz2")


@query(PART)
def parquet_round_trip(spark, d):
    return back(spark, d, "parts.parquet")


@query(PART)
def feather_round_trip(spark, d):
    return back(spark, d, "parts.feather")


@query(PART.replace("CASE WHEN p_size % 7 <> 0 THEN p_brand END AS brand", "CASE WHEN p_size % 7 <> 0 THEN p_brand ELSE '' END AS brand"))
def stata_round_trip(spark, d):
    """The format has no missing text; empty text stands for it."""
    return back(spark, d, "parts.dta")


@query(f"{PART} UNION ALL {PART}")
def ndjson_append(spark, d):
    df, path = parts(spark, d), f"{workspace(spark)}/parts.ndjson"
    writers.write_data(df, path)
    return readers.read_data(spark, writers.write_data(df, path, append=True), template=df)


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation")
def xz_scan(spark, d):
    """A text file in a compression that Spark cannot read itself."""
    path = f"{workspace(spark)}/nation.csv.xz"
    rows = table(spark, d, "nation").select("n_nationkey", "n_name").collect()  # 25 rows
    put(spark, path, lzma.compress(("n_nationkey,n_name\n" + "".join(f'{r[0]},"{r[1]}"\n' for r in rows)).encode()))
    return readers.read_data(spark, path).select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")


@query("SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name FROM nation UNION ALL SELECT CAST(r_regionkey AS BIGINT), r_name FROM region UNION ALL SELECT CAST(s_suppkey AS BIGINT), s_name FROM supplier")
def directory_scan(spark, d):
    """Files of several formats in one directory; a file of no known format is ignored."""
    folder = workspace(spark)
    rows = [(r[0], r[1]) for r in table(spark, d, "nation").select("n_nationkey", "n_name").collect()]  # 25 rows
    put(spark, f"{folder}/a.csv", ("k,name\n" + "".join(f"{k},{n}\n" for k, n in rows)).encode())
    lines = table(spark, d, "region").select(F.to_json(F.struct(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")))).collect()  # 5 rows
    put(spark, f"{folder}/b.ndjson", "\n".join(r[0] for r in lines).encode())
    writers.write_data(table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("k"), F.col("s_name").alias("name")), f"{folder}/c.feather")
    put(spark, f"{folder}/notes.bin", b"not a table")
    return readers.read_data(spark, folder).select(F.col("k").cast("long").alias("k"), "name")


@query("SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, o_orderstatus, CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 200000")
def scan_filter_project(spark, d):
    orders = readers.read_data(spark, f"{d}/orders.parquet")
    return orders.filter("o_orderpriority = '1-URGENT' and o_totalprice > 200000").select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"))


TABLE_OF_FORMATS = [
    ("csv", "csv", True, True), ("tsv", "tsv, tab", True, True), ("json", "json", True, True), ("ndjson", "ndjson, jsonl", True, True), ("parquet", "parquet, pq", True, True), ("feather", "feather, arrow, ipc", True, True),
    ("hdf5", "h5, hdf5, hdf", True, True), ("excel", "xlsx, xls", True, True), ("spss", "sav, zsav, por", True, True), ("stata", "dta", True, True), ("sas", "sas7bdat", True, False), ("xpt", "xpt", True, True),
    ("rds", "rds", False, False), ("rdata", "rda, rdata", False, False), ("fst", "fst", False, False),
]


@query(values(TABLE_OF_FORMATS, ["format", "extensions", "read", "write"]))
def supported_formats(spark, d):
    rows = [(f["format"], f["extensions"], f["read"], f["write"]) for f in formats.supported_formats()]
    return spark.createDataFrame(rows, "format string, extensions string, read boolean, write boolean")


PATHS = [
    ("a/b.CSV", None, "csv", None, "csv"), ("b.tab", None, "tsv", None, "tsv"), ("x.jsonl.gz", None, "ndjson", "gzip", "ndjson"), ("x.json.bz2", None, "json", "bzip2", "json"), ("x.csv.xz", None, "csv", "xz", "csv"), ("x.pq", None, "parquet", None, "parquet"),
    ("x.arrow", None, "feather", None, "feather"), ("x.bin", "h5", "hdf5", None, "h5"), ("x.xls", None, "excel", None, "xlsx"), ("x.zsav", None, "spss", None, "sav"), ("x.dta", None, "stata", None, "dta"), ("x.RData", None, "rdata", None, "rda"), ("x.txt", "TSV", "tsv", None, "tsv"),
]


@query(values([(p, f, c, e) for p, _, f, c, e in PATHS], ["path", "format", "compression", "extension"]))
def format_detection(spark, d):
    rows = []
    for path, name, *_ in PATHS:
        f, packed = formats.detect(path, name)
        rows.append((path, f.name, packed, formats.canonical_extension(f.name)))
    return spark.createDataFrame(rows, "path string, format string, compression string, extension string")


@query(values([("x.sas7bdat", "sas files cannot be written here; xpt, csv or parquet can be written instead"), ("x.rds", "rds files cannot be written here: an R session is needed"), ("x.fst", "fst files cannot be written here: an R session is needed"), ("x.parquet.gz", "parquet files cannot be gzip-compressed"), ("x.what", "cannot tell the format of 'x.what'; pass format=")], ["path", "message"]))
def refused_writes(spark, d):
    rows = []
    for path in ("x.sas7bdat", "x.rds", "x.fst", "x.parquet.gz", "x.what"):
        try:
            writers.write_data(spark.range(1), path)
        except (RuntimeError, ValueError) as e:
            rows.append((path, str(e)))
    return spark.createDataFrame(rows, "path string, message string")


DAY = "CAST(o_orderdate AS DATE)"


@query(f"""SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(coalesce(epoch_us(CASE o_orderkey % 8 WHEN 0 THEN CAST({DAY} AS TIMESTAMP) WHEN 1 THEN {DAY} + INTERVAL '10:11:12.345' HOUR WHEN 2 THEN {DAY} + INTERVAL '08:11:00' HOUR WHEN 3 THEN {DAY} + INTERVAL '10:11:00' HOUR
WHEN 4 THEN {DAY} + INTERVAL '10:11:12' HOUR WHEN 5 THEN {DAY} + INTERVAL '10:11:12.5' HOUR WHEN 6 THEN {DAY} + INTERVAL '15:41:12' HOUR END), -1) AS BIGINT) AS micros FROM orders""".replace(" HOUR", ""))
def parse_times(spark, d):
    key, day, slash = F.col("o_orderkey") % 8, F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "yyyy/MM/dd")
    shapes = [slash, F.concat(day, F.lit(" 10:11:12.345")), F.concat(day, F.lit(" 10:11+02:00")), F.concat(day, F.lit("T10:11")), F.concat(slash, F.lit(" 10:11:12")), F.concat(day, F.lit("T10:11:12.5Z")), F.concat(day, F.lit("T10:11:12-0530")), F.lit("soon")]
    text = shapes[7]
    for k in range(7):
        text = F.when(key == k, shapes[k]).otherwise(text)
    return table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.coalesce(F.unix_micros(readers.parse_datetime(text)), F.lit(-1).cast("long")).alias("micros"))


@query("""SELECT CAST(o_orderkey AS BIGINT) AS id, o_orderkey % 3 = 0 AS flag, CASE WHEN o_orderkey % 4 > 0 THEN (['low','mid','high'])[CAST(o_orderkey % 4 AS INTEGER)] END AS level, CAST(floor(o_totalprice) AS BIGINT) AS price,
CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS day, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey AS DOUBLE) END AS number, o_orderstatus AS extra FROM orders""")
def match_types_to_template(spark, d):
    """Texts of all columns, brought to the types of a template; what does not fit becomes NULL, further columns stay."""
    o = table(spark, d, "orders")
    texts = o.select(F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, "yes").otherwise(" F ").alias("flag"), (F.col("o_orderkey") % 4).cast("string").alias("level"), F.floor("o_totalprice").cast("string").alias("price"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.when(F.col("o_orderkey") % 5 == 0, "n/a").otherwise(F.col("o_orderkey").cast("string")).alias("number"), F.col("o_orderstatus").alias("extra"))
    template = spark.createDataFrame([], "id long, flag boolean, level string, price long, day date, number double")
    template = template.select(*[F.col(c).alias(c, metadata={"levels": ["low", "mid", "high"]} if c == "level" else {}) for c in template.columns])
    return readers.match_types(texts, template).withColumn("day", F.unix_date("day").cast("long"))


@query(f"SELECT a.v AS l_returnflag, b.v AS l_linestatus FROM {drawn_sql('l_returnflag', 'lineitem', 5000, 3)} a JOIN {drawn_sql('l_linestatus', 'lineitem', 5000, 3)} b ON a.i = b.i")
def generate_to_files(spark, d):
    """Rows generated straight into part files, read back."""
    real = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus")
    model = synthesizer.fit(real, copula="independence")
    told = writers.generate_to_file(model, spark, 5000, f"{workspace(spark)}/new.csv.gz", chunk_size=1500, seed=3)
    return readers.read_data(spark, told["path"], template=real)
