"""Every core query with a statement agrees with it on the smallest tables."""

import importlib

import pytest
from compare import connect, rows

MODULES = [
    "operators.mentions", "operators.evaluation", "operators.retrieval", "operators.graph", "operators.chunking", "operators.filters",
    "plans.planner", "operators.verification", "operators.extraction", "operators.significance", "operators.linking", "streaming.events", "sources.round_trips",
]


@pytest.mark.parametrize("module", MODULES)
def test_oracles(spark, sf, module):
    m = importlib.import_module(f"lanefold.{module}")
    con = connect(sf)
    bad = [n for n, sql in m.ORACLE.items() if rows(m.QUERIES[n](spark, sf).toPandas()) != rows(con.execute(sql).df())]
    assert not bad


@pytest.mark.parametrize("module", MODULES)
def test_queries_without_statement_run(spark, sf, module):
    m = importlib.import_module(f"lanefold.{module}")
    for name in set(m.QUERIES) - set(m.ORACLE):
        rows_ = m.QUERIES[name](spark, sf).toPandas()
        assert len(rows_) and not rows_.duplicated([c for c in rows_ if not rows_[c].map(lambda v: isinstance(v, (list, dict))).any()]).all(), name
