"""Every registered query with SQL, against DuckDB; the others run and give rows."""

from __future__ import annotations

import pytest

from plumbline.queries import REGISTRY, SQL

from .oracle import assert_same, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


#: At sf0.001 the known room has too few points for walls: its plan is tested at sf0.01.
LARGER = {"plan_rooms", "plan_openings", "plan_ceilings", "plan_features"}


@pytest.mark.parametrize("name", sorted(set(SQL) - LARGER))
def test_against_sql(spark, sf, con, name):
    assert_same(REGISTRY[name](spark, sf), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - set(SQL)))
def test_gives_rows(spark, sf, name):
    assert REGISTRY[name](spark, sf).count() > 0


def test_plan_of_the_known_room(spark, monkeypatch):
    """The queries on the known room's plan, which is made once for all of them."""
    from plumbline.queries import plans, surveys

    sf = "/root/testdata/sf0.01"
    made = []

    def once(*a, **k):
        made[:] = made or [plan_capture(*a, **k)]
        return made[0]

    plan_capture = plans.plan_capture
    monkeypatch.setattr(plans, "plan_capture", once)
    monkeypatch.setattr(surveys, "plan_capture", once)
    for name in sorted(LARGER):
        assert_same(REGISTRY[name](spark, sf), connect(sf), SQL[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
