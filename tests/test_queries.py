"""Every registered query of the engine against its SQL, with the cache on (each runs its statement twice)."""

import pytest

from skiplight.queries import ORACLES, QUERIES, SELECTS, engine_of, held

from .conftest import SF
from .oracle import agree, connect


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, con, name):
    agree(con, QUERIES[name](spark, SF), ORACLES[name])


@pytest.mark.parametrize("name", sorted(SELECTS))
def test_the_cache_changes_nothing(spark, name):
    """Off, cold and warm runs return the same rows."""
    tables, sql = SELECTS[name]
    e = engine_of(spark)
    text = sql.format(**{t: held(spark, SF, t) for t in tables})
    e.set_enabled(False)
    off = sorted(map(str, e.sql(text).collect()))
    e.set_enabled(True)
    assert sorted(map(str, e.sql(text).collect())) == off
    assert sorted(map(str, e.sql(text).collect())) == off
