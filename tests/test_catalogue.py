"""Every query of the catalogue against its SQL on the smallest tables."""

import math

import pytest

from procura.plans import catalogue

ORACLES = catalogue.oracle_sql()
ROWS_ONLY = sorted(set(catalogue.queries()) - set(ORACLES))


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if isinstance(v, bool) or v is None:
            return str(v)
        if isinstance(v, (int, float)) or v.__class__.__name__ == "Decimal":
            return "nan" if isinstance(v, float) and math.isnan(v) else f"{float(v):.9g}"
        return str(v)[:19] if hasattr(v, "isoformat") else str(v)

    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


def test_each_oracle_has_a_query():
    assert set(ORACLES) <= set(catalogue.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(name, spark, sf_dir, duck):
    df = catalogue.queries()[name](spark, sf_dir)
    found = duck.execute(ORACLES[name])
    want = canonical([c[0] for c in found.description], found.fetchall())
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == want


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_other_queries_give_rows(name, spark, sf_dir):
    assert catalogue.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() == 10
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_the_exported_network_has_its_documents(spark, sf_dir, duck):
    exported = catalogue.queries()["graph_export"](spark, sf_dir)
    found = exported.selectExpr("kind", "from_json(json, 'type string').type as type").groupBy("kind", "type").count().collect()
    n = {(r["kind"], r["type"]): r["count"] for r in found}
    lines = "lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey"
    documents, links = duck.execute(f"SELECT count(DISTINCT o_orderkey), count(DISTINCT (o_orderkey, p_name)) FROM {lines}").fetchone()
    assert n["node", "document"] == documents and n["edge", "contains"] == links
    assert n["stats", None] == 1 and n["dominant_supplier", None] == 5
