import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

from compare import make_spark  # noqa: E402

from shiftframe.functions.workspace import remove_made  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    checkpoints = str(tmp_path_factory.mktemp("shared"))
    session = make_spark(4, **{"spark.checkpoint.dir": checkpoints})
    yield session
    remove_made()
    session.stop()
