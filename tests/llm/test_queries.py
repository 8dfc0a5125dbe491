"""Every query of the package over its whole tables of the smallest scale."""

import os

import pytest

from bitweave.llm import queries as q

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(q.queries()))
def test_runs(spark, name):
    df = q.queries()[name](spark, DATA)
    assert df.count() > 0
