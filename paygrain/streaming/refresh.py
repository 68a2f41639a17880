"""New raw files become part of the next published version.

A file stream hands over what has arrived since the last run. Progress lives in
the stream's checkpoint. Each batch writes its own folders, and a version is
published only after all of it is written, so a run that dies at any point can
simply be started again; a batch that is already published is passed over.

What a batch costs follows the batch, not the history:

* Ids are kept in hash buckets. A batch reads the buckets its own ids fall in.
* A batch is counted alone. The reports are made from the counts of all
  batches, which add up.
* Ids, counts and facts are lists of folders. Whenever FAN_IN folders of one
  size stand in a list, they are merged into one of the next size, so a list
  stays short and a row is rewritten a logarithmic number of times.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from paygrain import model
from paygrain.operators.cleaning import first_copies, valid_amounts, with_derived
from paygrain.plans import rollups
from paygrain.plans.pipeline import write_reports
from paygrain.sources import files

KEY = "transaction_id"
BUCKETS = 1024
FAN_IN = 8

# A folder of a list and its size: how often it was merged.
Part = tuple[int, str]


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names for checkpoints."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        raise ValueError("spark.checkpoint.dir is not set; pass checkpoint=")
    return folder


def _bucketed(ids: DataFrame) -> DataFrame:
    return ids.select(KEY, F.pmod(F.xxhash64(KEY), F.lit(BUCKETS)).cast("int").alias("bucket"))


def _write_ids(ids: DataFrame, path: str) -> None:
    """A folder per bucket. Tasks hold whole buckets, so each writes few files."""
    ids.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def _read_ids(spark: SparkSession, paths: Sequence[str], kind: T.DataType) -> DataFrame:
    schema = T.StructType([T.StructField(KEY, kind), T.StructField("bucket", T.IntegerType())])
    return files.read_folders(spark, paths, schema)


def seen_ids(spark: SparkSession, parts: Sequence[Part], batch: DataFrame) -> DataFrame:
    """The known ids of the buckets that the batch's ids fall in, and no others."""
    touched = [r.bucket for r in _bucketed(batch.select(KEY)).select("bucket").distinct().collect()]
    known = _read_ids(spark, [path for _, path in parts], batch.schema[KEY].dataType)
    return known.where(F.col("bucket").isin(touched)).select(KEY)


def _merged(parts: list[Part], target: str, merge: Callable[[list[str], str], None]) -> list[Part]:
    """The list with folders of one size merged wherever there are FAN_IN of them."""
    size = 0
    while size <= max(n for n, _ in parts):
        equal = [path for n, path in parts if n == size]
        if len(equal) >= FAN_IN:
            path = f"{target}-{size + 1}"
            merge(equal, path)
            parts = [part for part in parts if part[0] != size] + [(size + 1, path)]
        size += 1
    return parts


def _state(spark: SparkSession, root: str) -> tuple[int, dict]:
    """The current version's number and lists; a version built in one go has one folder each."""
    try:
        manifest = files.latest(spark, root)
    except files.DatasetError:
        return 0, {"batch": -1, "tables": {}, "ids": [], "rollups": [], "facts": []}
    if "facts" in manifest:
        return manifest["number"], manifest
    built = manifest["tables"]["transactions"]
    ids = f"{root}/merged/ids-of-version-{manifest['number']}"
    _write_ids(_bucketed(files.read_by_month(spark, *built)), ids)
    lists = {"ids": [(0, ids)], "rollups": [(0, f"{manifest['folder']}/rollups")], "facts": [(0, p) for p in built]}
    return manifest["number"], {"batch": -1, "tables": manifest["tables"], **lists}


def add_batch(
    batch: DataFrame, batch_id: int, root: str, keep_first_by: Sequence[str]
) -> None:
    """Accept ids not seen before and publish a version with all accepted rows.

    Invalid first copies count as seen: their ids stay closed to later copies.
    Earlier batches win over later ones.
    """
    spark = batch.sparkSession
    number, state = _state(spark, root)
    if batch_id <= state["batch"]:
        return
    own = f"{root}/batches/{batch_id:08d}"
    fresh = first_copies(batch, [KEY], keep_first_by)
    if state["ids"]:
        known = seen_ids(spark, state["ids"], batch)
        fresh = fresh.join(known, KEY, "left_anti")
    fresh.write.mode("overwrite").parquet(f"{own}/fresh")
    fresh = spark.read.schema(fresh.schema).parquet(f"{own}/fresh")
    _write_ids(_bucketed(fresh), f"{own}/ids")
    clean = with_derived(valid_amounts(fresh))
    columns = [name for name in model.TRANSACTIONS_CLEAN.names if name in clean.columns]
    files.write_by_month(clean.select(*columns), f"{own}/facts")
    files.write_table(
        rollups.rollup(files.read_by_month(spark, f"{own}/facts")), f"{own}/rollups"
    )

    def merge_ids(paths: list[str], target: str) -> None:
        _write_ids(_read_ids(spark, paths, fresh.schema[KEY].dataType), target)

    def merge_rollups(paths: list[str], target: str) -> None:
        files.write_table(rollups.merged(spark.read.parquet(*paths)), target)

    def merge_facts(paths: list[str], target: str) -> None:
        files.write_by_month(files.read_by_month(spark, *paths), target)

    merges = {"ids": merge_ids, "rollups": merge_rollups, "facts": merge_facts}
    lists = {
        name: _merged(
            [*map(tuple, state[name]), (0, f"{own}/{name}")],
            f"{root}/merged/{name}-{batch_id:08d}",
            merge,
        )
        for name, merge in merges.items()
    }
    facts = [path for _, path in lists["facts"]]
    write_reports(
        spark,
        files.read_by_month(spark, *facts),
        [path for _, path in lists["rollups"]],
        f"{own}/reports",
    )
    tables = {**state["tables"], "transactions": facts}
    files.publish(spark, root, f"{own}/reports", tables, after=number, batch=batch_id, **lists)


def refresh(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    root: str,
    keep_first_by: Sequence[str],
    checkpoint: str | None = None,
    file_format: str = "parquet",
) -> StreamingQuery:
    """Process everything that has arrived in ``source``, then stop."""
    checkpoint = checkpoint or f"{checkpoint_root(spark)}/refresh"
    reader = spark.readStream.schema(schema)
    if file_format == "csv":
        reader = reader.option("header", True)
    return (
        reader.format(file_format)
        .load(source)
        .writeStream.foreachBatch(
            lambda batch, batch_id: add_batch(batch, batch_id, root, keep_first_by)
        )
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
