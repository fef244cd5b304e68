"""The corpus of long files reaches what files with a few findings cannot show."""

from pathlib import Path

import pytest

from workload import triage

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables not present")


def test_batches_behind_the_first_and_verdicts_across_batches(spark):
    rows = triage.QUERIES["session_verdicts"](spark, SF).collect()
    assert max(r.batch_no for r in rows) >= 2
    assert {True, False} == {r.kept for r in rows} == {r.kept_by_another_batch for r in rows}
