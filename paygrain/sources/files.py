"""File sources and sinks of the payments tables."""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paygrain import model
from paygrain.functions import values
from paygrain.model import FILE_ORDER, MALFORMED
from paygrain.operators.filters import require_columns

RAW_TABLES = ("customers", "cards", "merchants", "transactions")

# Cell texts that stand for a missing value.
NULL_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)


class DatasetError(RuntimeError):
    """A dataset is missing or cannot be read."""


class ConflictError(RuntimeError):
    """Another writer published a version first."""


def _as_missing(error: AnalysisException, message: str) -> Exception:
    """A DatasetError if nothing is there, and any other error as it is."""
    missing = error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")
    return DatasetError(message) if missing else error


def read_csv(
    spark: SparkSession, path: str, file_order: bool = False, line_breaks: bool = False
) -> DataFrame:
    """A CSV file or folder with a header, every column as text.

    Nothing is inferred, so leading zeros survive. A row with fewer cells than
    the header has names is filled up with nulls. One with more cells has none,
    but its text in MALFORMED, which is null for all other rows: see
    ``accepted``, ``rejected`` and ``strict``.

    With ``line_breaks`` a quoted cell may hold them; files are still split. A
    quote that is not closed then makes its row malformed as well; without, the
    parser closes it where the line ends.
    With ``file_order`` a column is added that sorts rows the way the files
    hold them: file, block within the file, row within the block.
    """
    try:
        names = spark.read.option("header", True).option("escape", '"').csv(path).columns
    except AnalysisException as error:
        raise _as_missing(error, f"not found: {path}") from error
    if not names:
        raise DatasetError(f"no header: {path}")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, MALFORMED]])
    options = {"escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": MALFORMED}
    if line_breaks:
        cells = F.from_csv("record", schema.simpleString()[7:-1].replace(":", " "), options)
        odd = F.when(F.regexp_count("record", F.lit('"')) % 2 == 1, F.col("record"))
        df = _records(spark, path).select("order", odd.alias("_odd"), cells.alias("cells"))
        df = df.select("order", "_odd", "cells.*").withColumn(
            MALFORMED, F.coalesce("_odd", MALFORMED)
        )
    else:
        # Unread columns are parsed as well: else a surplus cell goes unnoticed.
        reader = spark.read.options(header=True, columnPruning=False, **options).schema(schema)
        df = reader.csv(path).withColumn(
            "order",
            F.struct(
                "_metadata.file_path",
                "_metadata.file_block_start",
                F.monotonically_increasing_id().alias("row"),
            ),
        )
    too_long = _too_long(F.col(MALFORMED), len(names))
    cells = [
        F.when(~F.col(f"`{name}`").isin(*NULL_TOKENS) & ~too_long, F.col(f"`{name}`")).alias(name)
        for name in names
    ]
    # The first cell stands here because a scan of MALFORMED alone is refused.
    text = F.when(too_long, F.coalesce(MALFORMED, F.col(f"`{names[0]}`"))).alias(MALFORMED)
    order = [F.col("order").alias(FILE_ORDER)] if file_order else []
    return df.select(*cells, text, *order)


def _too_long(record: Column, names: int) -> Column:
    """Whether a record that the parser complained about has too many cells."""
    unquoted = F.regexp_replace(record, '"([^"]|"")*"', "")
    surplus = F.regexp_count(unquoted, F.lit(",")) >= names
    return F.coalesce(surplus | F.contains(unquoted, F.lit('"')), F.lit(False))


def _records(spark: SparkSession, path: str) -> DataFrame:
    """(order, record): the records below the header, whose cells may hold line breaks.

    A line break is inside a cell when an odd number of quotes stands before it
    in the file. Quotes are counted per line, summed over the blocks of a file
    (one row per block) and then within each block, so that a file is dealt
    over as many tasks as it has blocks. Only the lines of records of several
    lines are gathered, per record. In a file with an odd number of quotes one
    is not closed; there every line is a record of its own.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        F.col("value").alias("line"),
        F.regexp_count("value", F.lit('"')).alias("quotes"),
    )
    blocks = Window.partitionBy("file").orderBy("block")
    earlier = blocks.rowsBetween(Window.unboundedPreceding, -1)
    in_block = Window.partitionBy("file", "block").orderBy("row")
    above = in_block.rowsBetween(Window.unboundedPreceding, -1)

    def before(rows: DataFrame, counted: Column, name: str) -> DataFrame:
        """Add the sum of ``counted`` over the earlier blocks, and over the file."""
        sums = rows.groupBy("file", "block").agg(F.sum(counted).alias("n"))
        placed = sums.select(
            "file",
            "block",
            F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(name),
            F.sum("n").over(Window.partitionBy("file")).alias(f"{name}_in_file"),
        )
        return rows.join(placed, ["file", "block"])

    lines = before(lines, F.col("quotes"), "quoted")
    open_quotes = F.col("quoted") + F.coalesce(F.sum("quotes").over(above), F.lit(0))
    lines = lines.withColumn(
        "outside", (open_quotes % 2 == 0) | (F.col("quoted_in_file") % 2 == 1)
    ).where(~F.col("outside") | (values.strip(F.col("line")) != ""))
    lines = before(lines, F.col("outside").cast("long"), "earlier")
    lines = lines.withColumn(
        "number", F.col("earlier") + F.sum(F.col("outside").cast("long")).over(in_block)
    ).where(F.col("number") > 1)
    whole = F.col("outside") & ((F.col("quotes") % 2 == 0) | (F.col("quoted_in_file") % 2 == 1))
    place = F.struct(
        F.col("file").alias("file_path"), F.col("block").alias("file_block_start"), "row"
    )
    parts = (
        lines.where(~whole)
        .groupBy("file", "number")
        .agg(F.sort_array(F.collect_list(F.struct(place.alias("at"), "line"))).alias("parts"))
    )
    return lines.where(whole).select(place.alias("order"), F.col("line").alias("record")).unionByName(
        parts.select(
            F.get("parts", F.lit(0))["at"].alias("order"),
            F.array_join(F.col("parts.line"), "\n").alias("record"),
        )
    )


def accepted(df: DataFrame) -> DataFrame:
    """The well-formed rows of a table read from CSV."""
    return df.where(F.col(MALFORMED).isNull()).drop(MALFORMED) if MALFORMED in df.columns else df


def rejected(df: DataFrame) -> DataFrame:
    """The texts of the malformed rows, with their place if the table has it."""
    kept = [name for name in (FILE_ORDER, MALFORMED) if name in df.columns]
    return df.where(F.col(MALFORMED).isNotNull()).select(*kept)


def strict(df: DataFrame) -> DataFrame:
    """The table without MALFORMED; a malformed row fails the job that meets it."""
    if MALFORMED not in df.columns:
        return df
    found = F.raise_error(F.concat(F.lit("malformed row: "), F.col(MALFORMED))).cast("boolean")
    return df.where(F.when(F.col(MALFORMED).isNull(), F.lit(True)).otherwise(found)).drop(MALFORMED)


def read_raw(
    spark: SparkSession,
    folder: str,
    names: Iterable[str] = RAW_TABLES,
    line_breaks: bool = False,
) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """The raw tables that could be opened, and a message for each other one."""
    tables, problems = {}, {}
    for name in names:
        path = f"{folder}/{name}.csv"
        try:
            tables[name] = read_csv(spark, path, name == "transactions", line_breaks)
        except DatasetError as error:
            reason = str(error)
            problems[name] = (
                f"Required {name} dataset not found at {path}."
                if reason.startswith("not found")
                else f"Could not read {name} dataset at {path}: {reason}"
            )
    return tables, problems


REJECTED = "_rejected"


def load_mapped(df: DataFrame, schema: T.StructType, rejects: bool = False) -> DataFrame:
    """Text columns to a target schema; columns the schema lacks are discarded.

    Dates and flags are trimmed; a flag is true only for the text True. A cell
    that does not fit fails the job that reads it. With ``rejects`` it is null,
    and the column REJECTED lists the names of such cells, so that the rows
    without any go on and the others are kept beside them.
    """

    def converted(field: T.StructField) -> Column:
        cell = F.col(field.name)
        if isinstance(field.dataType, T.DateType):
            text = values.strip(cell)
            return F.try_to_date(text, "yyyy-MM-dd") if rejects else F.to_date(text, "yyyy-MM-dd")
        if isinstance(field.dataType, T.BooleanType):
            return values.strip(cell) == "True"
        if isinstance(field.dataType, T.StringType):
            return values.strip(cell) if field.name.endswith("_status") else cell
        return cell.try_cast(field.dataType) if rejects else cell.cast(field.dataType)

    cells = [converted(field).alias(field.name) for field in schema.fields]
    if rejects:
        unfit = [
            F.when(F.col(field.name).isNotNull() & converted(field).isNull(), F.lit(field.name))
            for field in schema.fields
        ]
        cells.append(F.array_compact(F.array(*unfit)).alias(REJECTED))
    return df.select(*cells)


def read_served(spark: SparkSession, path: str) -> DataFrame:
    """The cleaned fact as reports read it; checked on the schema alone.

    Plans built from this list the files now: call it again after a rewrite.
    """
    try:
        df = spark.read.parquet(path)
    except AnalysisException as error:
        raise _as_missing(error, f"no cleaned transactions at {path}") from error
    return require_columns(df, model.SERVED_COLUMNS, "the cleaned fact")


def read_safe(spark: SparkSession, path: str) -> DataFrame:
    """Only the nine columns without identifiers, pruned at the scan."""
    df = spark.read.parquet(path)
    return require_columns(df, model.SAFE_COLUMNS, "the cleaned fact").select(
        *model.SAFE_COLUMNS
    )


def write_table(df: DataFrame, path: str, file_format: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    if file_format == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.format(file_format).save(path)


def write_by_month(df: DataFrame, path: str) -> None:
    """The fact, partitioned by month for partition pruning.

    The rebalance hint gathers each month into files of the advisory size and
    lets Spark split a month that holds most of the table over many tasks.
    """
    (
        df.hint("rebalance", F.col("transaction_month"))
        .write.mode("overwrite")
        .partitionBy("transaction_month")
        .parquet(path)
    )


def read_by_month(spark: SparkSession, *paths: str) -> DataFrame:
    """Read back with the model's schema: month is text, empty facts included."""
    return read_folders(spark, paths, model.TRANSACTIONS_CLEAN)


def read_folders(spark: SparkSession, paths: Iterable[str], schema: T.StructType) -> DataFrame:
    """One table from several folders that are each partitioned for themselves."""
    parts = [spark.read.schema(schema).parquet(p).select(*schema.names) for p in paths]
    return reduce(DataFrame.unionByName, parts)


def export_documents(df: DataFrame, path: str) -> None:
    """One flat JSON document per row, ISO dates."""
    df.write.mode("overwrite").option("dateFormat", "yyyy-MM-dd").json(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Exported documents back as the cleaned fact; nothing is inferred."""
    return spark.read.schema(model.TRANSACTIONS_CLEAN).json(path)


def read_processed(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The current version's fact and dimensions, looked up anew on every call."""
    tables = latest(spark, root)["tables"]
    return {
        name: read_by_month(spark, *paths) if name == "transactions" else spark.read.parquet(*paths)
        for name, paths in tables.items()
    }


def register_views(tables: dict[str, DataFrame]) -> None:
    """The SQL model as temporary views, with the model's columns and types."""
    for name, schema in model.TABLES.items():
        if name in tables:
            tables[name].select(*schema.names).to(schema).createOrReplaceTempView(name)


def publish(
    spark: SparkSession,
    root: str,
    folder: str,
    tables: dict[str, list[str]],
    after: int | None = None,
    **state: object,
) -> int:
    """Make a completely written version the current one; its number.

    A version is a manifest: the folder of its reports, the folders of its
    tables, and what a writer wants to find again. Manifests are numbered one
    after the other, and a number can be taken once, so no clock decides which
    version is the last. Readers follow the highest number and see all tables
    of a version or none of them; a run that fails midway leaves the previous
    version in place.

    ``after`` is the number of the version this one was made from (0 for none).
    If another writer published since, that is a conflict and nothing changes.
    """
    number = after if after is not None else _last_number(spark, root)
    while True:
        number += 1
        manifest = {"number": number, "folder": folder, "tables": tables, **state}
        if _written_once(spark, f"{root}/published/{number:012d}.json", json.dumps(manifest)):
            return number
        if after is not None:
            raise ConflictError(f"version {number} of {root} was published by another writer")


def _written_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file; False if it is there already."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        stream = system.create(place, False)
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" in str(error.java_exception.getClass().getName()):
            return False
        raise
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    return True


def _manifests(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").load(f"{root}/published").select("path")


def _last_number(spark: SparkSession, root: str) -> int:
    try:
        path = _manifests(spark, root).agg(F.max("path")).first()[0]
    except AnalysisException as error:
        missing = _as_missing(error, "")
        if isinstance(missing, DatasetError):
            return 0
        raise
    return int(path.rsplit("/", 1)[1].removesuffix(".json")) if path else 0


def latest(spark: SparkSession, root: str) -> dict:
    """The current version's manifest, looked up anew on every call.

    A manifest whose writer died while writing it is passed over.
    """
    number = _last_number(spark, root)
    while number > 0:
        path = f"{root}/published/{number:012d}.json"
        text = spark.read.text(path, wholetext=True).agg(F.max("value")).first()[0]
        try:
            return json.loads(text or "")
        except json.JSONDecodeError:
            number -= 1
    raise DatasetError(f"nothing published under {root}")


def current(spark: SparkSession, root: str) -> str:
    """Folder of the current version's reports."""
    return latest(spark, root)["folder"]
