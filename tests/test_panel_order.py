"""Sums that decide on rows come out the same whatever the order and the number of files."""

from datetime import datetime

import pytest

from meshwork.plans import catalogue
from meshwork.plans import kernels  # noqa: F401

#: (event_id, day of January, user_id, value). User 1's second day adds up to 3 in the order of event_id, to less in reverse.
EVENTS = [(2, 1, 1, 1.5), (1, 2, 1, 0.4), (4, 2, 1, 0.7), (7, 2, 1, 1.9), (5, 1, 2, 1.5), (10, 2, 2, 1.25)]


@pytest.mark.parametrize("layout", ["reverse", "in order", "a file each"])
def test_listwise_deletion_adds_in_order(spark, tmp_path, layout):
    assert (0.4 + 0.7) + 1.9 == 3.0 > (1.9 + 0.7) + 0.4
    rows = [(i, datetime(2024, 1, day, 12), user, value) for i, day, user, value in EVENTS]
    frame = spark.createDataFrame(rows[::-1] if layout == "reverse" else rows, "event_id long, ts timestamp, user_id long, value double")
    frame = frame.repartition(6) if layout == "a file each" else frame.coalesce(1)
    frame.write.parquet(str(tmp_path / "events.parquet"))
    got = catalogue.QUERIES["listwise_deletion"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [(2, 1, 1.5625, 1.875)]  # user 1's outcome is a multiple of 3, and missing
    sums = catalogue.panel(spark, str(tmp_path), in_order=True).where("subject = 1 AND beep = 19724").collect()
    assert [(r.v0, r.v1, r.v2) for r in sums] == [(0.0, 3.0, 0.0)]
