"""Every registered query against its SQL twin on the smallest tables."""

import pytest
from twin import SMALL, compare

from catalog import QUERIES


@pytest.mark.parametrize("name", list(QUERIES))
def test_twin(spark, twins, name):
    equal, note = compare(spark, twins, SMALL, name)
    assert equal, note
