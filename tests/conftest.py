import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from isoweave.runtime import get_spark

    s = get_spark("tests", "4", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__sql__codegen__wholeStage="true")
    s.sparkContext.setLogLevel("ERROR")
    return s
