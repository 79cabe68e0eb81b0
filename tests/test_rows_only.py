"""Queries without SQL give rows with a stable schema."""

from __future__ import annotations

import pytest

from pitframe.plans import catalog


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracles())))
def test_rows(spark, sf_dir, name):
    df = catalog.queries()[name](spark, sf_dir)
    assert len(df.collect()) > 0
    assert df.columns
