"""Links between photos: a photo brings its best links only, however many suppliers its nation has."""

from __future__ import annotations

from plumbline.operators import rooms
from plumbline.queries import REGISTRY


def test_five_links_a_photo(spark, sf, monkeypatch):
    given = []
    run = rooms.cross_room_matches
    monkeypatch.setattr(rooms, "cross_room_matches", lambda e, keys: given.append(e) or run(e, keys))
    suppliers = spark.range(4000).selectExpr("id AS s_suppkey", "CAST(id % 2 AS int) AS s_nationkey")
    customers = spark.range(100).selectExpr("id AS c_custkey", "CAST(id % 3 AS int) AS c_nationkey")
    monkeypatch.setattr("plumbline.queries.surveys.table", lambda spark, sf_dir, name: customers if name == "customer" else suppliers)
    REGISTRY["photo_links"](spark, sf)
    assert given[0].count() == 67 * 5
