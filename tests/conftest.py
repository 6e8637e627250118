import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from runlens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    return local_session(8, "8g", str(tmp_path_factory.mktemp("shared")))


TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def ts(spark):
    """The prepared panel at the smallest scale, stored once for all tests."""
    from runlens.operators.curate import prepare_runs, scenario_dim
    from runlens.sources import fixtures
    from runlens.sources.scratch import stored

    return stored(prepare_runs(fixtures.ts(spark, TINY), scenario_dim(spark)), "ts")
