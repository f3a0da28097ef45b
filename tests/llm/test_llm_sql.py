import pytest
from sqlcheck import check

from tesselon.llm import queries


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_equals_its_sql(spark, name):
    check(spark, queries, name)
