"""Every registered query of the city package against its SQL, on the smallest tables."""

import pytest

from streetloom import queries
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, db, name):
    assert compare(queries.QUERIES[name](spark, SF), db, queries.ORACLES[name]) is None


@pytest.mark.parametrize("name", ["kmeans_embeddings", "building_classifier", "influence_templates", "tessellation", "right_neighbours", "major_sections"])
def test_without_sql_gives_rows(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0
