"""Readers and writers. Each is a thin, declarative use of Spark's own sources, so pushdown and pruning stay with Catalyst."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as TY

QA = "data array<struct<title: string, paragraphs: array<struct<context: string, qas: array<struct<id: string, question: string, is_impossible: boolean, answers: array<struct<text: string>>>>>>>>"


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_config(spark: SparkSession, path: str, config: str, split: str | None = None) -> DataFrame:
    """A named configuration, or one of its splits, of a dataset laid out as path/config=.../split=...: other folders aren't listed."""
    rows = spark.read.parquet(path).filter(F.col("config") == config)
    return (rows.filter(F.col("split") == split) if split is not None else rows).drop("config", "split")


def read_json(spark: SparkSession, path: str, schema: str | None = None, multi_line: bool = False) -> DataFrame:
    """JSON lines, or files of one document or array each; the schema is inferred if none is given."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.option("multiLine", multi_line).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str | TY.StructType, lenient: bool = False) -> DataFrame:
    """JSON lines, gzipped or not. Lenient: lines that don't parse are skipped, as are unreadable files."""
    reader = spark.read.schema(schema)
    return reader.option("mode", "DROPMALFORMED").option("ignoreCorruptFiles", "true").json(path) if lenient else reader.json(path)


#: Fields keep their white space, line breaks of any kind and backslashes.
_CSV = {"header": True, "escape": '"', "lineSep": "\n", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_csv(spark: SparkSession, path: str, schema: str | TY.StructType) -> DataFrame:
    """Quoted empty fields are empty texts, bare ones null: a mark that no file has stands for the former while the reader tells them apart."""
    mark = uuid.uuid4().hex
    df = spark.read.schema(schema).csv(path, multiLine=True, nullValue="", emptyValue=mark, **_CSV)
    return df.select(*[F.when(F.col(c) == mark, "").otherwise(F.col(c)).alias(c) if kind == "string" else F.col(c) for c, kind in df.dtypes])


def read_piped(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Headerless tables with | between the columns, whose names the schema gives."""
    return spark.read.schema(schema).csv(path, sep="|", quote="")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def year_of_file(df: DataFrame) -> DataFrame:
    """The year in a row's file name; a name without one is an error."""
    year = F.regexp_extract(F.element_at(F.split(F.input_file_name(), "/"), -1), r"((?:19|20)\d\d)", 1)
    return df.withColumn("year", F.when(year != "", year.cast("int")).otherwise(F.raise_error(F.lit("a file name has no year"))))


def nested_qa(df: DataFrame) -> DataFrame:
    """(title, context, id, question, is_impossible, answers) of nested question answering data."""
    p = df.select(F.explode("data").alias("d")).select("d.title", F.explode("d.paragraphs").alias("p"))
    return p.select("title", "p.context", F.explode("p.qas").alias("q")).select("title", "context", "q.id", "q.question", "q.is_impossible", F.transform("q.answers", lambda a: a["text"]).alias("answers"))


def keyed_object(df: DataFrame, column: str, value_schema: str) -> DataFrame:
    """A JSON object keyed by id as rows (id, value)."""
    return df.select(F.explode(F.from_json(column, f"map<string, {value_schema}>")).alias("id", "value"))


def shard_of(key, shards: int):
    """The shard of a key, by 32 bits of its MD5."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long"), F.lit(shards))


def shard(df: DataFrame, key: str, index: int, shards: int) -> DataFrame:
    """Shard `index` of `shards`, by the hash of the key."""
    return df.filter(shard_of(F.col(key), shards) == index)


def payload_digest(content) -> F.col:
    """SHA-256 of the first 400 bytes, as the reference's integrity check has it."""
    return F.sha2(F.substring(content, 1, 400), 256)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", by: list[str] | None = None) -> None:
    """Mode errorifexists refuses, ignore skips and overwrite replaces what is there."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists", compression: str = "gzip") -> None:
    df.write.mode(mode).json(path, compression=compression)


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """one_file is for small reports."""
    (df.coalesce(1) if one_file else df).write.csv(path, **_CSV)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """Distinct values in order, one a line."""
    df.select(F.col(column).cast("string").alias("value")).distinct().orderBy("value").write.text(path)


def write_kept_and_removed(df: DataFrame, path: str, reason: str = "reason") -> None:
    """Rows without a reason as Parquet, the others beside them as gzipped JSON with their reason."""
    df.filter(F.col(reason).isNull()).drop(reason).write.parquet(f"{path}/kept")
    df.filter(F.col(reason).isNotNull()).write.json(f"{path}/removed", compression="gzip")


def upsert_by(df: DataFrame, path: str, column: str) -> None:
    """Replace the partitions of the values in df, leave the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def append_new(df: DataFrame, path: str, key: str, schema: TY.StructType) -> None:
    """Append rows whose key the table lacks: a rerun adds nothing."""
    from pyspark.errors import AnalysisException

    try:
        done = df.sparkSession.read.schema(schema).parquet(path).select(key)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition()):
            raise
        df.write.parquet(path)
        return
    df.join(done, key, "left_anti").select(*schema.names).write.mode("append").parquet(path)


def missing(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """The rows of df whose keys a Parquet table at path lacks; all if there is no table."""
    from pyspark.errors import AnalysisException

    try:
        done = df.sparkSession.read.parquet(path).select(*keys).distinct()
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return df
    return df.join(done, keys, "left_anti")


def process_shards(df: DataFrame, path: str, process, shard: str = "shard") -> None:
    """process(rows of the shards that path lacks) written by shard: a run that broke off goes on with what is missing. Shards are read, processed and written side by side."""
    process(missing(df, path, [shard])).write.mode("append").partitionBy(shard).parquet(path)


def enrich(df: DataFrame, path: str, key: str, f, schema: str, batch: int = 100) -> None:
    """f(list of rows as dicts) -> list of dicts of schema, in batches, for the rows whose key path lacks; appended, so a rerun asks for nothing twice."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for i in range(0, len(b), batch):
                got = f(b.slice(i, batch).to_pylist())
                yield pa.RecordBatch.from_pylist(got, kinds) if got else pa.RecordBatch.from_pylist([], kinds)

    from pyspark.sql.pandas.types import to_arrow_schema

    struct = df.sparkSession.createDataFrame([], schema).schema
    kinds = to_arrow_schema(struct)
    missing(df, path, [key]).mapInArrow(run, struct).write.mode("append").parquet(path)


def write_report(df: DataFrame, path: str, line) -> None:
    """A small report as text: a line for each row, as the expression has it, in the order of rows sorted by all columns."""
    df.orderBy(*df.columns).select(line.cast("string").alias("value")).coalesce(1).write.text(path)


def _files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))


def write_matrix(blocks: DataFrame, path: str, width: int, file_rows: int = 4096, order: str = "block_id", ids: str = "input_ids") -> None:
    """Rows of `width` int32 ids in the order of a dense block id, as raw little-endian files of file_rows rows each: what a trainer maps into memory.

    A file has a name by its place, so a task that is run again writes the same file.
    """
    import numpy as np
    import pyarrow as pa

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by(order)
        x = np.asarray(t.column(ids).combine_chunks().flatten(), "<i4")
        if len(x) != len(t) * width:
            raise ValueError(f"a block hasn't {width} ids")
        place = t.column("__file")[0].as_py()
        system, folder = _files(path)
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/{place:08d}.i4", compression=None) as out:
            out.write(x.tobytes())
        return pa.table({"file": pa.array([place], pa.int64()), "rows": pa.array([len(t)], pa.int64())})

    rows = blocks.select(F.col(order).cast("long"), F.col(ids).cast("array<int>"), F.floor(F.col(order) / file_rows).cast("long").alias("__file"))
    rows.groupBy("__file").applyInArrow(run, "file long, rows long").write.mode("overwrite").parquet(f"{path.rstrip('/')}-files")


def read_matrix(spark: SparkSession, path: str, width: int, multiple: int = 1, file_rows: int = 4096) -> DataFrame:
    """(block_id, input_ids) of such files; rows beyond the last whole multiple (of a batch, say) are left out."""
    import numpy as np
    import pyarrow as pa

    files = spark.read.parquet(f"{path.rstrip('/')}-files")
    usable = (files.agg(F.sum("rows")).first()[0] or 0) // multiple * multiple

    def run(batches):
        for b in batches:
            for place in b.column(0).to_pylist():
                system, folder = _files(path)
                with system.open_input_stream(f"{folder}/{place:08d}.i4", compression=None) as f:
                    x = np.frombuffer(f.read(), "<i4").reshape(-1, width)
                for i in range(0, len(x), 512):
                    part = x[i : i + 512]
                    at = pa.array(np.arange(len(part) + 1, dtype=np.int32) * width)
                    yield pa.RecordBatch.from_arrays([pa.array(place * file_rows + i + np.arange(len(part))), pa.ListArray.from_arrays(at, pa.array(part.ravel()))], ["block_id", "input_ids"])

    return files.select("file").repartition("file").mapInArrow(run, "block_id long, input_ids array<int>").filter(F.col("block_id") < usable)
