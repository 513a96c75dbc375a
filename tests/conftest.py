import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from claimlens.session import local_session
    s = local_session(cores="*", shuffle_partitions=8, app="claimlens-tests")
    yield s


@pytest.fixture(scope="session")
def claims_small(spark):
    from claimlens.sources.fixtures import claims
    return claims(spark, SF_SMALL)
