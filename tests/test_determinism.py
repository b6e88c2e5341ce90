"""Recomputation gives the same rows (what a retried task after executor loss does).

Operators that depend on partition layout, ties or range sampling are run
twice on freshly planned inputs and must agree row for row.
"""

import pytest

import __spark_entry__ as E
from tests.conftest import SMOKE_DIR

LAYOUT_SENSITIVE = ["temporal_split", "checkpoint_gaps", "route_risk_all", "whatif_routes",
                    "whatif_routes_pruned", "shipments_summary", "roc_auc", "average_precision",
                    "shipments_upsert", "recent_telemetry"]


@pytest.mark.parametrize("name", LAYOUT_SENSITIVE)
def test_query_is_deterministic(spark, name):
    first = sorted(map(tuple, E.queries()[name](spark, SMOKE_DIR).collect()), key=repr)
    second = sorted(map(tuple, E.queries()[name](spark, SMOKE_DIR).collect()), key=repr)
    assert first == second
