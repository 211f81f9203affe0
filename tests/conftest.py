import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from vectorloom import local_session  # noqa: E402

TOY = ["human interface computer", "survey user computer system response time", "eps user interface system",
       "system human system eps", "user response time", "trees", "graph trees", "graph minors trees", "graph minors survey"]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "tests", spark__sql__shuffle__partitions="4")


@pytest.fixture(scope="session")
def toy(spark):
    return spark.createDataFrame([(i, t.split()) for i, t in enumerate(TOY)], "doc_id long, tokens array<string>").cache()
