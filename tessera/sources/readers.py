"""Readers: JSONL, JSON arrays, TSV, wrapped arrays, client shards, text, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

CORRUPT = "_corrupt_record"


def jsonl(spark: SparkSession, path: str, schema: StructType | str, strict: bool = False) -> DataFrame:
    """One object a line; blank lines are skipped.  Broken lines are kept in
    ``_corrupt_record``, or fail the read where it is strict."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    whole = StructType([*fields.fields, StructField(CORRUPT, StringType())])
    return spark.read.schema(whole).option("columnNameOfCorruptRecord", CORRUPT).json(path)


def json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A top-level list of objects.  Such a file is one task: convert it once."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Tab-separated with a header, doubled quotes and line ends within quotes."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    return spark.read.schema(schema).csv(path, sep="\t", header=True, quote='"', escape='"', multiLine=True)


def wrapped_array(spark: SparkSession, path: str, schema: StructType | str, array: str) -> DataFrame:
    """Header fields beside one big array: a row for each element."""
    whole = spark.read.schema(schema).option("multiLine", True).json(path)
    header = [c for c in whole.columns if c != array]
    return whole.select(*header, F.explode(array).alias("_e")).select(*header, "_e.*")


def client_shards(spark: SparkSession, path: str, schema: StructType | str, clients: int) -> DataFrame:
    """``client_<i>`` JSON lines files of a folder with their ``client_id``; all
    of ``0 .. clients - 1`` must be there."""
    rows = spark.read.schema(schema).option("pathGlobFilter", "client_*").json(path).withColumn("_f", F.col("_metadata.file_name"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "client_*").load(path).select("path")
    seen = files.select(F.regexp_extract("path", r"client_(\d+)[^/]*$", 1).cast("int").alias("client_id")).distinct()
    lost = spark.range(clients).select(F.col("id").cast("int").alias("client_id")).join(seen, "client_id", "left_anti").orderBy("client_id")
    names = [r[0] for r in lost.limit(20).collect()]
    if names:
        raise FileNotFoundError(f"no shard of clients {names}")
    return rows.withColumn("client_id", F.regexp_extract("_f", r"client_(\d+)", 1).cast("int")).drop("_f")


def plain_text(df: DataFrame, names: tuple[str, ...] = ("text", "content", "email_body", "body")) -> DataFrame:
    """One ``text`` column: the first known name, else the first column."""
    return df.select(F.col(next((n for n in names if n in df.columns), df.columns[0])).cast("string").alias("text"))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    return plain_text(spark.read.text(path))


def file_listing(spark: SparkSession, path: str, pattern: str = "*.{png,jpg,jpeg}") -> DataFrame:
    """``path, length`` of matching files at any depth; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return found.load(path).select("path", "length")


def split_file(spark: SparkSession, folder: str, split: str, candidates: tuple[str, ...]) -> str:
    """The first existing ``folder/candidate`` (``{split}`` filled in), else the
    first file that a wildcard on the split finds; through the Hadoop file system."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(folder)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for c in candidates:
        path = jvm.org.apache.hadoop.fs.Path(base, c.format(split=split))
        if fs.exists(path):
            return path.toString()
    found = sorted(s.getPath().toString() for s in fs.globStatus(jvm.org.apache.hadoop.fs.Path(base, f"*{split}*")))
    if not found:
        raise FileNotFoundError(f"no file of split {split!r} in {folder}")
    return found[0]
