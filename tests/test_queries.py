"""Every registered query of the reference's operators against its DuckDB twin."""

import pytest
from oracle import connect, same

from hoistway import registry


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, small, con, name):
    df = registry.QUERIES[name](spark, small)
    if name in registry.ORACLE_SQL:
        same(df, con, registry.ORACLE_SQL[name])
    else:
        assert df.count() > 0


def test_rest_works_without_llm():
    import subprocess
    import sys

    code = "import sys; sys.modules['hoistway.llm'] = None; import __spark_entry__ as e; assert e.queries() and not [q for q in e.queries() if q.startswith('op')]; assert 'pipeline' not in e.queries()"
    from pathlib import Path

    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, timeout=120).returncode == 0
