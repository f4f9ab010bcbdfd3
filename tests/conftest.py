import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from jobledger.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        4,
        **{
            "spark.master": "local[4]",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


ROW = """JobID string, Submit string, Start string, End string, ElapsedRaw long, AllocCPUS long, CPUTimeRAW long, ReqMem string,
MaxRSS string, TotalCPU string, State string, QOS string, Comment string, JobName string, Elapsed string, Account string,
NodeList string"""


@pytest.fixture
def accounting(spark):
    """Builds accounting rows from dicts; columns left out are null."""
    names = [part.split()[0] for part in ROW.replace("\n", " ").split(",")]

    def build(*rows, **types):
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ROW)

    return build
