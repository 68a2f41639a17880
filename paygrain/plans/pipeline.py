"""The batch pipeline: raw tables to cleaned tables, summaries and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession

from paygrain import model
from paygrain.operators.anomalies import known_anomalies
from paygrain.operators.cleaning import clean_transactions, public_cards
from paygrain.plans import rollups
from paygrain.sources import files

def write_reports(
    spark: SparkSession,
    fact: DataFrame,
    rollup_paths: Sequence[str],
    folder: str,
    file_format: str = "parquet",
) -> None:
    """All reports from the written rollups; only the review list reads the fact.

    It reads the part of it whose amounts may be unusual: the bounds follow
    from the counts, so they are known before the scan and files are skipped.
    """
    totals = rollups.merged(spark.read.parquet(*rollup_paths))
    for name, report in rollups.REPORTS.items():
        files.write_table(report(totals), f"{folder}/{name}", file_format)
    spread = rollups.amount_spread(totals).first()
    flagged = known_anomalies(fact, spread.mean, spread.std)
    files.write_table(flagged, f"{folder}/amount_anomalies", file_format)


def build_processed(
    spark: SparkSession,
    tables: dict[str, DataFrame],
    root: str,
    version: str,
    keep_first_by: Sequence[Column | str] = (files.FILE_ORDER,),
    keep_rejected: bool = False,
) -> str:
    """Write one version of all processed tables and make it current.

    The fact is cleaned and written once and counted once; the reports are
    derived from those counts. A malformed row of a CSV file fails the run;
    with ``keep_rejected`` it is written to ``rejected`` instead.
    """
    folder = f"{root}/{version}"
    if keep_rejected:
        for name, df in tables.items():
            if files.MALFORMED in df.columns:
                files.write_table(files.rejected(df), f"{folder}/rejected/{name}")
    read = files.accepted if keep_rejected else files.strict
    tables = {name: read(df) for name, df in tables.items()}
    fact = clean_transactions(tables["transactions"], keep_first_by)
    known = [name for name in model.TRANSACTIONS_CLEAN.names if name in fact.columns]
    written = {
        "transactions": [f"{folder}/transactions_clean"],
        "customers": [f"{folder}/customers_clean"],
        "cards": [f"{folder}/cards_public"],
        "merchants": [f"{folder}/merchants_clean"],
    }
    files.write_by_month(fact.select(*known), *written["transactions"])
    files.write_table(tables["customers"], *written["customers"])
    files.write_table(tables["merchants"], *written["merchants"])
    files.write_table(public_cards(tables["cards"]), *written["cards"])
    clean = files.read_by_month(spark, *written["transactions"])
    files.write_table(rollups.rollup(clean), f"{folder}/rollups")
    write_reports(spark, clean, [f"{folder}/rollups"], folder)
    files.publish(spark, root, folder, written)
    return folder
