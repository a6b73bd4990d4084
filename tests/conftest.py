import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from oremill.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, shuffle_partitions=2, memory="6g")
    # Compiling a class per stage takes longer than interpreting these tiny inputs.
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    return session
