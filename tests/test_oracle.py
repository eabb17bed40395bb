"""Every registered query against its SQL in DuckDB; none may be empty where correctness is gated."""

import pytest
from compare import connect, difference

from driftline.plans import catalog, registry  # noqa: F401

SF, GATE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.fixture(scope="module")
def gate():
    return connect(GATE)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, con):
    df = registry.QUERIES[name](spark, SF)
    if name in registry.ORACLE:
        assert difference(df, con, registry.ORACLE[name]) is None
    else:
        assert df.count() > 0


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_result_is_not_empty(name, gate):
    assert gate.sql(registry.ORACLE[name]).limit(1).fetchall()


@pytest.mark.parametrize(
    ("name", "column", "least"),
    [
        ("agg02b_facets", "facet", 3),
        ("agg11_flight_stats", "grouping", 4),
        ("cmp01_flight_score", "tier", 4),
        ("cmp03_landings_at_airport", "grade", 5),
        ("cmp03_landings_at_airport", "inferred", 2),
        ("cmp02_recent_landings", "home", 2),
        ("win15b_track_phase", "phase", 4),
        ("win20_intent_rules", "intent", 6),
    ],
)
def test_every_kind_of_row_occurs(name, column, least, gate):
    rows = gate.sql(registry.ORACLE[name])
    at = rows.columns.index(column)
    assert len({r[at] for r in rows.fetchall()}) >= least
