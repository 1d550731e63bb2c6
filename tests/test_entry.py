import importlib
import os

import pytest

entry = importlib.import_module("__spark_entry__")
SF = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_flagship_query(spark):
    assert entry.entry(spark).count() == 20
