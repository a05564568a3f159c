import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

# user functions defined in test modules run in Python workers: ship them by value
try:
    from pyspark import cloudpickle

    if __package__ and __package__ in sys.modules:
        cloudpickle.register_pickle_by_value(sys.modules[__package__])
except Exception:
    pass

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from commitlens.session import build_session, clean_scratch
    s = build_session(cores=4, shuffle_partitions=8, app="commitlens-tests")
    yield s
    clean_scratch(s)
    s.stop()
