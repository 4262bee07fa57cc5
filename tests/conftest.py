import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from carepulse.session import local_session
    ckpt = tempfile.mkdtemp(prefix="carepulse-test-", dir="/tmp")
    s = local_session("*", 8, app="carepulse-tests",
                      extra={"spark.checkpoint.dir": ckpt})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck01():
    from oracle_compare import duck
    return duck(SF01)


@pytest.fixture(scope="session")
def adm01(spark):
    """The fixture admissions at sf0.01, written once to the checkpoint folder."""
    from carepulse.plans.registry import materialized_admissions
    return materialized_admissions(spark, SF01)
