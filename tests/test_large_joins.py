"""Tables that grow with the input meet by key: nothing of them is broadcast through the driver, whatever their files weigh."""

import pytest
from pyspark.sql import functions as F

from docassay.operators import network as G
from docassay.plans import network as NQ
from docassay.session import durable
from docassay.sources.adapters_legal import encumbrances


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def apps(spark):
    rows = [(f"C{i}", f"bank{i % 3}", kind, f"{kind}{i // n}") for i in range(9) for kind, n in (("payout_account", 3), ("device", 9), ("phone", 1))]
    return durable(spark.createDataFrame(rows, "case_id string, bank_id string, kind string, token string"))


def test_rings_broadcast_nothing(apps):
    edges = G.token_edges(apps)
    assert "Broadcast" not in plan(edges)
    comp = G.components(apps.select("case_id").distinct(), edges)
    assert "Broadcast" not in plan(comp)
    assert {r["component"] for r in comp.collect()} == {"C0"}
    ring = G.rings(apps, durable(comp))
    assert "Broadcast" not in plan(ring)
    assert [(r["members"], r["banks"], r["shared"]) for r in ring.collect()] == [(9, 3, "device:9,payout_account:3")]
    told = G.ring_advisories(ring, durable(comp))
    assert "Broadcast" not in plan(told) and told.count() == 9


def test_edited_statements_broadcast_nothing(spark):
    from docassay.operators import statement as S

    txns = durable(spark.createDataFrame([("a", 0, 500, None, 1500), ("a", 1, None, 200, 1300)], "doc_id string, idx int, credit_p bigint, debit_p bigint, balance_p bigint"))
    heads = durable(spark.createDataFrame([("a", 1000, 1300, 200, 500, 0, 0, 0)], "doc_id string, opening_p bigint, closing_p bigint, total_debits_p bigint, total_credits_p bigint, interest_p bigint, charges_p bigint, uncaptured int"))
    grid, edited = S.edit_grid(heads, txns)
    v = S.violations(grid.drop("field"), edited, base=heads)
    assert "Broadcast" not in plan(v)
    rows = v.select("doc_id", "violations").collect()
    assert len(rows) == 12 and all(r["violations"] > 0 for r in rows)


def test_except_on_dealt_pairs(spark, tmp_path):
    """Equal pairs, missing keys and undisclosed references; a split's pairs are dealt out before they are made distinct."""
    rows = [(1, 10), (1, 10), (1, 4), (2, 33), (2, 4), (3, None), (3, None), (None, 4), (None, 5)]
    spark.createDataFrame(rows, "l_partkey bigint, l_orderkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    cert, deed = encumbrances(spark, str(tmp_path))
    assert plan(cert).count("REPARTITION_BY_COL") == 1 and plan(cert).count("Exchange") == 1
    assert sorted(map(str, cert.collect())) == sorted(map(str, spark.createDataFrame(
        [(1, "R10"), (1, "R4"), (2, "R33"), (2, "R4"), (3, None), (None, "R4"), (None, "R5")], "bundle_id bigint, ref string").collect()))
    assert deed.filter("ref = 'none'").count() == 3 and deed.filter("ref is null").count() == 1
    found = {tuple(r) for r in NQ.se03(spark, str(tmp_path)).collect()}
    assert found == {(1, "R4"), (2, "R33"), (2, "R4"), (None, "R4")}
    assert "Broadcast" not in plan(NQ.se03(spark, str(tmp_path)))


def test_identity_texts_are_dealt_over_all_cores(spark, folder):
    from docassay.sources import adapters as A

    assert spark.read.parquet(f"{folder}/customer.parquet").rdd.getNumPartitions() == 1
    cores = spark.sparkContext.defaultParallelism
    assert A.kyc_text(spark, folder).rdd.getNumPartitions() == cores > 1
    assert A.applications(spark, folder).rdd.getNumPartitions() == cores


@pytest.fixture
def few(spark, tmp_path):
    """Customers, orders and lines, each in one small file."""
    def put(name, sql):
        spark.sql(sql).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")

    put("customer", "SELECT id AS c_custkey, 'BUILDING' AS c_mktsegment, 100.5D AS c_acctbal FROM range(40)")
    put("orders", "SELECT id AS o_orderkey, id % 40 AS o_custkey, 'F' AS o_orderstatus, '2-HIGH' AS o_orderpriority, date '1995-01-01' + cast(id AS int) AS o_orderdate, 10.25D * id AS o_totalprice FROM range(200)")
    put("lineitem", "SELECT id AS l_orderkey, 1 AS l_linenumber, id AS l_partkey, id AS l_suppkey, date '1995-01-01' AS l_shipdate, 5.5D AS l_extendedprice, 0.1D AS l_tax, 0.2D AS l_discount, 3D AS l_quantity FROM range(200)")
    return str(tmp_path)


def test_rows_that_become_many_stay_apart(spark, few):
    """Statements, agreements and deeds lie in one split or few bytes; their claims are not made by one task."""
    from docassay.plans import runs as Q
    from docassay.sources import adapters as A
    from docassay.sources import adapters_legal as L

    n = spark.sparkContext.defaultParallelism
    assert spark.read.parquet(f"{few}/orders.parquet").rdd.getNumPartitions() == 1 < n
    for df, rows in ((A.ledger(spark, few), 200), (L.agreements(spark, few), 200), (Q.deed_claims(spark, few), 400)):
        assert df.rdd.getNumPartitions() == n
        assert df.count() == rows


def test_pages_are_made_of_orders_dealt_out(spark, few):
    """Pages are parsed once, behind the shuffle: the items do not read the orders again."""
    from docassay.plans import evaluate as E
    from docassay.sources import intake as I

    pages = E.extraction_pages(spark, few)
    assert "orders.parquet" not in plan(I.extraction_items(pages)) and pages.rdd.getNumPartitions() > 1
    assert pages.count() == 200
