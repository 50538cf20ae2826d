import re

import pytest

from rillflow.llm import registry

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op2_winnowing", "op3_sharding", "op6_mixing"])
def test_native_operators_have_no_python(spark, name):
    text = registry.queries()[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|Python|Pandas|Arrow|NestedLoop", text)
