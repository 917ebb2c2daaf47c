"""Every query of the engine's own operators against its SQL, or, where SQL can't express it, that it gives rows."""

from __future__ import annotations

import pytest

from moraine.plans import registry
from tests.compare import DATA, compare

SMALL = DATA / "sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, name):
    assert compare(registry.QUERIES[name](spark, str(SMALL)), registry.ORACLE_SQL[name], SMALL) > 0


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_gives_rows(spark, name):
    df = registry.QUERIES[name](spark, str(SMALL))
    assert df.columns and df.count() > 0
