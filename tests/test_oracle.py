"""Every registered query beside its SQL on the smallest tables."""

import pytest

from checks import all_checks
from compare import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", list(all_checks()))
def test_query_equals_sql(spark, duck, name):
    item = all_checks()[name]
    frame = item.run(spark, SF)
    if item.sql is None:
        assert frame.count() > 0
    else:
        assert differences(frame, duck, item.sql) == []
