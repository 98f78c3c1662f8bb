import os

import pytest
from oracle import differs
from plumbline.plans import corpora, tables

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", [*tables.SQL, *corpora.SQL])
def test_query_equals_sql(spark, name):
    module = tables if name in tables.SQL else corpora
    assert differs(spark, SF, module.queries()[name], module.SQL[name]) is None
