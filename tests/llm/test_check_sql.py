"""The operators that SQL can express, over whole tables."""

from __future__ import annotations

import pytest

from bazaarflow.llm.queries import ORACLE, QUERIES
from tests.oracle import connect, difference


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, folder, name):
    bigger = folder.replace("0.001", "0.01")
    assert difference(QUERIES[name](spark, bigger), ORACLE[name], connect(bigger)) is None


def test_every_operator_has_a_query():
    assert {q.split("_")[0] for q in QUERIES} == {f"op{n}" for n in range(1, 14)}
