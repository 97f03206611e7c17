"""Files: CSV with exact text, partitioned Parquet, manifests and the stage registry."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from duoscope.runtime import fresh_path, shared_dir

#: No empty text becomes null and no null becomes text by accident.
_CSV = {"header": True, "nullValue": "\\N", "escape": '"'}


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).options(**_CSV).csv(path)


def read_csv_strings(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Every value as it is written."""
    return read_csv(spark, path, StructType([StructField(c, StringType()) for c in columns]))


def write_csv(df: DataFrame, path: str, order: list[Column] | None = None) -> None:
    """One file in a given order where the table is a report; without an order, a file for each partition."""
    (df.orderBy(*order).coalesce(1) if order else df).write.mode("overwrite").options(**_CSV).csv(path)


def csv_round_trip(df: DataFrame, typed: bool) -> DataFrame:
    path = fresh_path(df.sparkSession, "csv")
    write_csv(df, path)
    return read_csv(df.sparkSession, path, df.schema) if typed else read_csv_strings(df.sparkSession, path, df.columns)


def write_partitioned(df: DataFrame, path: str, by: str, key: str) -> None:
    """A folder for each value of a column with few values, rows dealt by a key: no file for each key."""
    df.repartition(by, key).write.mode("overwrite").option("compression", "zstd").partitionBy(by).parquet(path)


def partitioned(df: DataFrame, by: str, key: str) -> DataFrame:
    path = fresh_path(df.sparkSession, "partitioned")
    write_partitioned(df, path, by, key)
    return df.sparkSession.read.parquet(path)


def splice(base: DataFrame, other: DataFrame, key: str, column: str) -> DataFrame:
    """The base with one column from another table of texts; all others stay as they are written."""
    new = other.select(key, F.col(column).alias("new_"))
    return base.join(new, key, "left").select(*[F.coalesce("new_", c).alias(c) if c == column else F.col(c) for c in base.columns])


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, md5) of all files below a folder, made where the files are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.col("length").alias("bytes"), F.md5("content").alias("md5"))


def compare_manifest(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(path, problem): files that are missing, not listed, or different."""
    both = found.select("path", F.col("md5").alias("have")).join(expected.select("path", F.col("md5").alias("want")), ["path"], "full")
    problem = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "not listed").when(F.col("have") != F.col("want"), "different")
    return both.select("path", problem.alias("problem")).filter("problem is not null")


class Registry:
    """Named stages, each made once for each variant and fingerprint of what it is made from."""

    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        self.spark, self.root = spark, root or f"{shared_dir(spark)}/registry"

    def path(self, name: str, variant: str = "", inputs: dict | None = None) -> str:
        key = hashlib.md5(json.dumps([variant, inputs or {}], sort_keys=True).encode()).hexdigest()[:12]
        return f"{self.root}/{name}-{key}"

    def exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def get(self, name: str, make: Callable[[], DataFrame], variant: str = "", inputs: dict | None = None) -> DataFrame:
        """The stage's table; made only where it isn't complete."""
        path = self.path(name, variant, inputs)
        if not self.exists(path):
            make().write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.parquet(path)


class Steps:
    """Named steps with what they need; each runs once and leaves a marker in a shared folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.steps = spark, root, {}

    def add(self, name: str, run: Callable[[], object], needs: list[str] | None = None) -> None:
        self.steps[name] = (run, needs or [])

    def done(self, name: str) -> bool:
        return _file_system(self.spark, f"{self.root}/{name}.done", lambda fs, at: fs.exists(at))

    def run(self) -> None:
        """Runs what has no marker yet, after what it needs. A step that fails leaves none and ends the run."""
        seen: set[str] = set()

        def visit(name: str) -> None:
            if name in seen:
                return
            seen.add(name)
            run, needs = self.steps[name]
            for other in needs:
                visit(other)
            if not self.done(name):
                run()
                put_text(self.spark, f"{self.root}/{name}.done", "")

        for name in self.steps:
            visit(name)


def _file_system(spark: SparkSession, path: str, use: Callable):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return use(at.getFileSystem(spark._jsc.hadoopConfiguration()), at)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file through the file system that Spark uses."""

    def use(fs, at) -> None:
        out = fs.create(at, True)
        out.write(text.encode())
        out.close()

    _file_system(spark, path, use)


def get_text(spark: SparkSession, path: str) -> str:
    return spark.read.option("wholetext", True).text(path).first()[0]


def float_text(x: Column) -> Column:
    """A double's shortest text, with exponents as 1e-07 rather than 1.0E-7, and plain digits from 1e-04 up to 1e16."""
    text = x.cast("string")
    mantissa, exponent = F.regexp_replace(F.split_part(text, F.lit("E"), F.lit(1)), r"\.0$", ""), F.split_part(text, F.lit("E"), F.lit(2)).try_cast("int")
    two = lambda e: F.when(e < 10, F.concat(F.lit("0"), e.cast("string"))).otherwise(e.cast("string"))
    small, large = F.concat(mantissa, F.lit("e-"), two(-exponent)), F.concat(mantissa, F.lit("e+"), two(exponent))
    digits = F.regexp_replace(F.format_string("%.20f", x), r"(\.\d+?)0+$", "$1")
    return F.when(exponent.isNull(), text).when(exponent < -4, small).when(exponent >= 16, large).otherwise(digits)


def row_groups(names: DataFrame) -> DataFrame:
    """(file, row_group, name, n_rows, dictionary, encodings) of each column of each row group of Parquet files (a column of paths), from their footers."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs

        for batch in batches:
            out = []
            for file in batch.column(0).to_pylist():
                system, path = fs.FileSystem.from_uri(file)
                with system.open_input_file(path) as f:
                    meta = pq.ParquetFile(f).metadata
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    for c in range(group.num_columns):
                        column = group.column(c)
                        out.append((file, g, column.path_in_schema, group.num_rows, column.has_dictionary_page, list(column.encodings)))
            kinds = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.bool_(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["file", "row_group", "name", "n_rows", "dictionary", "encodings"])

    return names.mapInArrow(run, "file string, row_group int, name string, n_rows long, dictionary boolean, encodings array<string>")
