import pytest

from lectern.session import get_spark


@pytest.fixture(scope="session")
def spark():
    s = get_spark("local[4]", **{"spark.sql.shuffle.partitions": "4"})
    yield s
    s.stop()
