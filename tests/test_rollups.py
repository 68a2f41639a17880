import pytest
from pyspark.sql import functions as F

from paygrain.operators import measures
from paygrain.plans import reports, rollups
from paygrain.sources import orders_feed as feed
from tests.conftest import rows
from tests.fixtures import served, served_row


@pytest.fixture(scope="module")
def tx(spark, sf):
    return feed.full_transactions(spark, sf)


@pytest.mark.parametrize("name", sorted(rollups.REPORTS))
def test_reports_from_counts_equal_reports_from_rows(spark, tx, name):
    half = F.xxhash64("transaction_id") % 2 == 0
    stacked = rollups.rollup(tx.where(half)).unionByName(rollups.rollup(tx.where(~half)))
    totals = rollups.merged(stacked)
    assert rows(rollups.REPORTS[name](totals)) == rows(getattr(reports, name)(tx))


def test_spread_from_sums(tx):
    totals = rollups.merged(rollups.rollup(tx))
    got = rollups.amount_spread(totals).first()
    expected = measures.spread(tx, "amount").first()
    assert got.mean == pytest.approx(expected.mean, rel=1e-12)
    assert got.std == pytest.approx(expected["std"], rel=1e-9)


def test_null_keys_and_empty_facts(spark):
    odd = served(spark, [served_row(4, None, "M1", "Shop One", None, 7, "Completed", "B", "Debit")])
    totals = rollups.merged(rollups.rollup(odd))
    for name, report in rollups.REPORTS.items():
        assert rows(report(totals)) == rows(getattr(reports, name)(odd)), name
    empty = rollups.merged(rollups.rollup(odd.where("false")))
    assert [rows(report(empty)) for report in rollups.REPORTS.values()] == [[]] * 5
    assert rollups.amount_spread(empty).first().mean is None
