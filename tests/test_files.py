import csv
import os
import random
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import types as T

from paygrain import model
from paygrain.operators import quality
from paygrain.operators.cleaning import clean_transactions
from paygrain.plans import reports
from paygrain.plans.pipeline import build_processed
from paygrain.sources import files
from paygrain.streaming import refresh
from tests.conftest import rows
from tests.fixtures import served, served_row

HEADER = (
    "transaction_id,card_id,customer_id,merchant_id,merchant_name,merchant_category,"
    "transaction_date,amount,currency,transaction_type,transaction_status,payment_method,"
    "merchant_city,merchant_state,bank_name,card_type,customer_city,customer_state,description"
)


def line(number, amount="10.50", status="Completed", day="2026-01-05", name="Shop"):
    return (
        f'T{number},K1,C1,M1,{name},Retail,{day},{amount},INR,Purchase,{status},Chip,'
        "Pune,Maharashtra,Axis Bank,Debit,Delhi,Delhi,text"
    )


def raw_folder(tmp_path, *lines):
    folder = tmp_path / "raw"
    folder.mkdir(exist_ok=True)
    (folder / "transactions.csv").write_text("\n".join([HEADER, *lines]) + "\n")
    (folder / "customers.csv").write_text(
        "customer_id,first_name,last_name,gender,age,email,phone,city,state,occupation,"
        "annual_income,registration_date\n"
        "C1,A,B,Male,30,a@example.com,0123456789,Delhi,Delhi,Doctor,500000,2025-01-01\n"
    )
    (folder / "cards.csv").write_text(
        "card_id,customer_id,card_type,bank_name,card_network,issue_date,expiry_date,"
        "card_status,card_number,cvv\n"
        "K1,C1,Debit,Axis Bank,Visa,2024-01-01,2028-01-01,Active,4111111111111111,123\n"
    )
    (folder / "merchants.csv").write_text(
        "merchant_id,merchant_name,merchant_category,city,state,contact_person,email,phone,"
        "registration_date,merchant_status\n"
        'M1,"Shanker, Lalla and Bora",Retail,Pune,Maharashtra,P,p@example.com,099,2024-01-01, Active \n'
    )
    return str(folder)


def test_text_survives_reading(spark, tmp_path):
    tables, problems = files.read_raw(spark, raw_folder(tmp_path, line(1)))
    assert problems == {} and set(tables) == set(files.RAW_TABLES)
    assert tables["customers"].first().phone == "0123456789"
    assert tables["merchants"].first().merchant_name == "Shanker, Lalla and Bora"


def test_null_tokens(spark, tmp_path):
    tables, _ = files.read_raw(
        spark, raw_folder(tmp_path, line(1, name="NA"), line(2, name=""), line(3, name="Nanny"))
    )
    names = [r["merchant_name"] for r in rows(tables["transactions"], "transaction_id")]
    assert names == [None, None, "Nanny"]


def test_file_order_decides_the_first_copy(spark, tmp_path):
    lines = [line(i % 50, amount=f"{1 + i}") for i in range(400)]
    folder = raw_folder(tmp_path, *lines)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        raw = files.read_raw(spark, folder)[0]["transactions"]
        assert raw.rdd.getNumPartitions() > 4
        clean = clean_transactions(raw, [files.FILE_ORDER])
        got = {r.transaction_id: r.amount for r in clean.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {f"T{i}": Decimal(1 + i).quantize(Decimal("0.01")) for i in range(50)}


def test_column_mapping_load(spark, tmp_path):
    tables, _ = files.read_raw(spark, raw_folder(tmp_path, line(1)))
    loaded = files.load_mapped(tables["merchants"], model.MERCHANTS_SQL)
    assert loaded.columns == list(model.MERCHANTS_SQL.names)
    row = loaded.first()
    assert (row.merchant_status, row.registration_date) == ("Active", date(2024, 1, 1))
    flags = spark.createDataFrame([(" True ", "False", "1")], "a string, b string, c string")
    schema = T.StructType([T.StructField(n, T.BooleanType()) for n in "abc"])
    assert tuple(files.load_mapped(flags, schema).first()) == (True, False, False)


def test_pipeline_publishes_whole_versions(spark, tmp_path):
    root = str(tmp_path / "out")
    folder = raw_folder(tmp_path, line(1), line(1, "99"), line(2, "0"), line(3, status="Failed"))
    with pytest.raises(files.DatasetError):
        files.current(spark, root)
    tables, _ = files.read_raw(spark, folder)
    build_processed(spark, tables, root, "v1")
    first = files.current(spark, root)
    assert first.endswith("/v1")
    fact = files.read_by_month(spark, f"{first}/transactions_clean")
    assert [r["transaction_id"] for r in rows(fact, "transaction_id")] == ["T1", "T3"]
    assert fact.schema == model.TRANSACTIONS_CLEAN
    summary = spark.read.parquet(f"{first}/customer_summary").first()
    assert (summary.successful_transactions, summary.successful_spend) == (1, 10.5)
    cards = spark.read.parquet(f"{first}/cards_public")
    assert not set(model.CARD_SECRETS) & set(cards.columns)
    flagged = spark.read.parquet(f"{first}/amount_anomalies")
    assert flagged.count() == 0 and "amount_z_score" in flagged.columns
    (tmp_path / "raw" / "transactions.csv").write_text(
        "\n".join([HEADER, line(1), line(7)]) + "\n"
    )
    build_processed(spark, files.read_raw(spark, folder)[0], root, "v2")
    second = files.current(spark, root)
    assert second.endswith("/v2")
    processed = files.read_processed(spark, root)
    assert {name: df.count() for name, df in processed.items()} == {
        "transactions": 2, "customers": 1, "cards": 1, "merchants": 1
    }
    assert reports.kpi(processed["transactions"]).first().completed_amount == 21.0


def test_month_partitions_are_pruned(spark, tmp_path):
    path = str(tmp_path / "fact")
    columns = [n for n in model.TRANSACTIONS_CLEAN.names if n != "description"]
    tx = served(spark).selectExpr(*columns, "'d' AS description")
    files.write_by_month(tx, path)
    plan = (
        files.read_by_month(spark, path)
        .where("transaction_month = '2026-01'")
        ._jdf.queryExecution().executedPlan().toString()
    )
    assert "PartitionFilters: [isnotnull(transaction_month" in plan
    empty = str(tmp_path / "empty")
    files.write_by_month(tx.where("false"), empty)
    assert files.read_by_month(spark, empty).count() == 0


def test_served_reader(spark, tmp_path):
    path = str(tmp_path / "served")
    with pytest.raises(files.DatasetError, match="no cleaned transactions"):
        files.read_served(spark, path)
    served(spark).write.parquet(path)
    assert files.read_served(spark, path).count() == 3
    more = served_row(4, "C3", "M2", "Shop Two", "Grocery", 5, "Completed", "B", "Debit")
    served(spark, [more]).write.mode("overwrite").parquet(path)
    assert files.read_served(spark, path).count() == 4
    assert files.read_safe(spark, path).columns == list(model.SAFE_COLUMNS)
    served(spark).drop("currency", "bank_name").write.mode("overwrite").parquet(path)
    with pytest.raises(ValueError, match="bank_name, currency"):
        files.read_served(spark, path)


def test_views_answer_plain_sql(spark, sf):
    from paygrain.sources import orders_feed as feed

    tables = feed.clean_tables(spark, sf)
    files.register_views(
        {
            "customers": tables["customers"],
            "cards_public": tables["cards"],
            "merchants": tables["merchants"],
            "transactions_clean": tables["transactions"],
        }
    )
    asked = spark.sql(
        "SELECT merchant_id, count(*) AS n FROM transactions_clean "
        "GROUP BY merchant_id HAVING count(*) >= 5 AND avg(CAST(is_failure AS DOUBLE)) > "
        "(SELECT avg(CAST(is_failure AS DOUBLE)) FROM transactions_clean)"
    )
    expected = reports.merchant_risk(tables["transactions"])
    assert sorted(tuple(r) for r in asked.collect()) == sorted(
        (r.merchant_id, r.transaction_count) for r in expected.collect()
    )
    orphans = spark.sql(
        "SELECT count(*) AS n FROM transactions_clean t "
        "LEFT ANTI JOIN cards_public c ON c.card_id = t.card_id"
    )
    assert orphans.first().n == 0


def test_json_documents_have_iso_dates(spark, tmp_path):
    path = str(tmp_path / "docs")
    files.export_documents(served(spark), path)
    back = spark.read.json(path)
    assert sorted(r.transaction_date for r in back.collect())[0] == "2026-01-01"
    typed = files.read_documents(spark, path)
    assert typed.schema == model.TRANSACTIONS_CLEAN
    assert reports.document_monthly(typed).collect() == reports.document_monthly(
        served(spark)
    ).collect()


def test_csv_reports_have_a_header_when_empty(spark, tmp_path):
    path = str(tmp_path / "csv")
    files.write_table(served(spark).where("false").select("amount"), path, "csv")
    assert spark.read.option("header", True).csv(path).columns == ["amount"]


SCHEMA = "transaction_id string, transaction_date string, amount string, transaction_status string, customer_id string, merchant_id string, merchant_name string, merchant_category string"


def arrive(spark, folder, *data):
    full = [(*row, "C1", "M1", "Shop", "Retail") for row in data]
    spark.createDataFrame(full, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_refresh_adds_what_arrives(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    arrive(
        spark, source,
        ("T1", "2026-01-01", "10", "Completed"),
        ("T2", "2026-01-01", "0", "Completed"),
    )
    schema = spark.read.parquet(source).schema

    def run():
        query = refresh.refresh(
            spark, source, schema, root, ["amount"], checkpoint=str(tmp_path / "ckpt")
        )
        assert query.awaitTermination(120)
        if query.exception():
            raise query.exception()

    run()
    status = spark.read.parquet(f"{files.current(spark, root)}/status_distribution")
    assert [tuple(r) for r in status.collect()] == [("Completed", 1)]
    arrive(
        spark, source,
        ("T1", "2026-01-01", "99", "Completed"),
        ("T2", "2026-01-01", "5", "Completed"),
        ("T3", "2026-02-01", "7", "Failed"),
    )
    run()
    folder = files.current(spark, root)
    status = spark.read.parquet(f"{folder}/status_distribution")
    assert sorted(tuple(r) for r in status.collect()) == [("Completed", 1), ("Failed", 1)]
    customers = spark.read.parquet(f"{folder}/customer_summary").first()
    assert customers.successful_spend == 10.0
    run()
    assert files.current(spark, root) == folder


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "out")
    source = str(tmp_path / "in")
    arrive(spark, source, ("T1", "2026-01-01", "10", "Completed"))
    batch = spark.read.parquet(source)
    refresh.add_batch(batch, 0, root, ["amount"])
    refresh.add_batch(batch, 0, root, ["amount"])
    assert files.read_processed(spark, root)["transactions"].count() == 1
    assert files.latest(spark, root)["number"] == 1
    status = spark.read.parquet(f"{files.current(spark, root)}/status_distribution")
    assert [tuple(r) for r in status.collect()] == [("Completed", 1)]


def batch_of(spark, ids, amount="10"):
    rows = [(f"T{i}", "2026-01-01", amount, "Completed", "C1", "M1", "Shop", "Retail") for i in ids]
    return spark.createDataFrame(rows, SCHEMA)


def test_batches_are_merged_and_stay_whole(spark, tmp_path, monkeypatch):
    """After several merges every row, id and count is there once."""
    monkeypatch.setattr(refresh, "FAN_IN", 2)
    monkeypatch.setattr(refresh, "BUCKETS", 4)
    root = str(tmp_path / "out")
    for n in range(5):
        ids = range(n * 3, n * 3 + 5)  # two of them known from the batch before
        refresh.add_batch(batch_of(spark, ids, amount=f"{n + 1}"), n, root, ["amount"])
    state = files.latest(spark, root)
    assert all(len(state[name]) <= 3 for name in ("ids", "rollups", "facts"))
    fact = files.read_processed(spark, root)["transactions"]
    got = {r.transaction_id: int(r.amount) for r in fact.collect()}
    assert fact.count() == len(got) == 17
    assert got == {f"T{i}": min(max(0, (i - 2) // 3), 4) + 1 for i in range(17)}
    status = spark.read.parquet(f"{files.current(spark, root)}/status_distribution")
    assert [tuple(r) for r in status.collect()] == [("Completed", 17)]


def test_a_batch_reads_what_its_ids_touch(spark, tmp_path, monkeypatch):
    """The same files for a short and a long history; none of other buckets."""
    monkeypatch.setattr(refresh, "BUCKETS", 16)
    opened = []
    for size in (50, 1500):
        root = str(tmp_path / f"out{size}")
        refresh.add_batch(batch_of(spark, range(size)), 0, root, ["amount"])
        batch = batch_of(spark, [7, 5000])
        seen = refresh.seen_ids(spark, files.latest(spark, root)["ids"], batch)
        plan = seen._jdf.queryExecution().executedPlan()
        assert seen.count() < size / 3
        assert "PartitionFilters: [bucket" in plan.toString().replace("isnotnull(bucket", "bucket")
        touched = {r.bucket for r in refresh._bucketed(batch).collect()}
        every = {f.rsplit("bucket=", 1)[1].split("/")[0] for f in seen.inputFiles()}
        opened.append(len(touched))
        assert len(every) > len(touched)
        refresh.add_batch(batch, 1, root, ["amount"])
        assert files.read_processed(spark, root)["transactions"].count() == size + 1
    assert opened[0] == opened[1] == len(touched)


def test_a_refresh_goes_on_from_a_built_version(spark, tmp_path):
    root = str(tmp_path / "out")
    tables, _ = files.read_raw(spark, raw_folder(tmp_path, line(1), line(2, status="Failed")))
    build_processed(spark, tables, root, "v1")
    refresh.add_batch(batch_of(spark, [2, 3]), 0, root, ["amount"])
    processed = files.read_processed(spark, root)
    assert {name: df.count() for name, df in processed.items()} == {
        "transactions": 3, "customers": 1, "cards": 1, "merchants": 1
    }
    status = spark.read.parquet(f"{files.current(spark, root)}/status_distribution")
    assert sorted(tuple(r) for r in status.collect()) == [("Completed", 2), ("Failed", 1)]


def test_two_writers_and_no_clock(spark, tmp_path):
    root = str(tmp_path / "out")
    assert files.publish(spark, root, "a", {}) == 1
    # Both made theirs from version 1: the second one must not hide the first.
    assert files.publish(spark, root, "b", {}, after=1) == 2
    with pytest.raises(files.ConflictError):
        files.publish(spark, root, "c", {}, after=1)
    assert files.current(spark, root) == "b"
    # Numbers decide, not the files' times; a manifest cut off midway is passed over.
    os.utime(tmp_path / "out/published/000000000001.json", (2**31, 2**31))
    (tmp_path / "out/published/000000000003.json").write_text('{"number": 3, "fol')
    assert files.current(spark, root) == "b"
    assert files.publish(spark, root, "d", {}) == 4
    assert files.latest(spark, root) == {"number": 4, "folder": "d", "tables": {}}


def test_other_errors_are_not_taken_for_a_missing_table(spark, tmp_path):
    with pytest.raises(files.DatasetError):
        files.latest(spark, str(tmp_path / "nothing"))
    with pytest.raises(Exception) as error:
        files.read_served(spark, "nosuchscheme://a/b")
    assert not isinstance(error.value, files.DatasetError)


RAGGED = (
    'a,b,c\n1,"two\nlines, here",3\n\n4,"blank\n\n""inside""",6\n'
    '7,8,9,10\n11,12\n13,"a\nb",14,15\n16,,"x"\n'
)


def cells(df):
    return [tuple(r)[:3] for r in df.orderBy(files.FILE_ORDER).collect()]


@pytest.mark.parametrize("block", ["128m", "16"])
def test_quoted_line_breaks_and_ragged_rows(spark, tmp_path, block):
    """Also when the file is read in blocks that end anywhere."""
    (tmp_path / "t.csv").write_text(RAGGED)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        df = files.read_csv(spark, str(tmp_path / "t.csv"), file_order=True, line_breaks=True)
        good, bad = cells(files.accepted(df)), cells(files.rejected(df))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert good == [
        ("1", "two\nlines, here", "3"), ("4", 'blank\n\n"inside"', "6"), ("11", "12", None), ("16", None, "x")
    ]
    assert [row[1] for row in bad] == ["7,8,9,10", '13,"a\nb",14,15']


def test_quoted_line_breaks_of_many_files(spark, tmp_path):
    rng = random.Random(3)
    want = []
    for name in range(4):
        with open(tmp_path / f"{name}.csv", "w", newline="") as file:
            writer = csv.writer(file, lineterminator="\n")
            writer.writerow(["key", "text"])
            for i in range(200):
                text = "".join(rng.choices(["x", "\n", '"', ",", " y"], k=rng.randrange(12)))
                writer.writerow([f"{name}-{i}", f"t{text}t"])
                want.append((f"{name}-{i}", f"t{text}t"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        df = files.read_csv(spark, str(tmp_path), line_breaks=True)
        assert sorted(tuple(r) for r in files.strict(df).collect()) == sorted(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_quote_that_is_not_closed_spoils_its_line_only(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n1,2\n3,"open\n5,6\n')
    df = files.read_csv(spark, str(tmp_path / "t.csv"), True, line_breaks=True)
    assert [row[:2] for row in cells(files.accepted(df))] == [("1", "2"), ("5", "6")]
    assert [row[1] for row in cells(files.rejected(df))] == ['3,"open']
    df = files.read_csv(spark, str(tmp_path / "t.csv"), True)
    assert [row[:2] for row in cells(df)] == [("1", "2"), ("3", "open"), ("5", "6")]


def test_malformed_rows_are_counted_not_fatal(spark, tmp_path):
    folder = raw_folder(tmp_path, line(1), line(2) + ",surplus", line(3, name='"two\nlines"'), "T4,K1")
    tables, problems = files.read_raw(spark, folder, line_breaks=True)
    assert problems == {}
    found = {(r.rule, r.dataset, r.column): r.violations for r in quality.rule_counts(tables).collect()}
    assert found[("V1", "transactions", "")] == 1 and found[("V1", "cards", "")] == 0
    # The other rules read the three well-formed rows; T4 lacks all but two cells.
    assert found[("V4", "transactions", "merchant_name")] == 1
    assert found[("V3", "transactions", "transaction_id")] == 0
    assert not [key for key in found if key[2].startswith("_")]
    with pytest.raises(Exception, match="malformed row: T2"):
        build_processed(spark, tables, str(tmp_path / "out"), "v1")
    with pytest.raises(files.DatasetError):
        files.current(spark, str(tmp_path / "out"))


def test_rejected_rows_are_kept_beside_the_accepted(spark, tmp_path):
    folder = raw_folder(tmp_path, line(1), line(2) + ",surplus")
    tables, _ = files.read_raw(spark, folder)
    root = str(tmp_path / "out")
    version = build_processed(spark, tables, root, "v1", keep_rejected=True)
    assert files.read_processed(spark, root)["transactions"].count() == 1
    rejected = spark.read.parquet(f"{version}/rejected/transactions")
    assert [r[files.MALFORMED][:3] for r in rejected.collect()] == ["T2,"]
    assert spark.read.parquet(f"{version}/rejected/cards").count() == 0


def test_mapped_load_with_rejects(spark):
    schema = "merchant_id string, registration_date string, age string, merchant_status string, extra string"
    rows = [("M1", " 2024-01-01 ", "7", " Active ", "x"), ("M2", "2024-13-01", "7", None, "x"), ("M3", None, "seven", "a", "x")]
    target = T.StructType(
        [
            T.StructField("merchant_id", T.StringType()),
            T.StructField("registration_date", T.DateType()),
            T.StructField("age", T.IntegerType()),
            T.StructField("merchant_status", T.StringType()),
        ]
    )
    df = spark.createDataFrame(rows, schema)
    loaded = {r.merchant_id: r for r in files.load_mapped(df, target, rejects=True).collect()}
    assert tuple(loaded["M1"])[1:] == (date(2024, 1, 1), 7, "Active", [])
    assert loaded["M2"][files.REJECTED] == ["registration_date"] and loaded["M2"].age == 7
    assert loaded["M3"][files.REJECTED] == ["age"] and loaded["M3"].registration_date is None
    with pytest.raises(Exception):
        files.load_mapped(df, target).collect()


def test_checkpoint_root_comes_from_the_session(spark):
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        assert refresh.checkpoint_root(spark) == folder
    else:
        with pytest.raises(ValueError):
            refresh.checkpoint_root(spark)
