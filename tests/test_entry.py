import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_registries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p1_found", "p7_found", "tfidf_topk"} <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_flagship(spark):
    assert entry.queries()["tfidf_topk"](spark, SMALL).count() > 0
