"""commitlens: code-history analytics expressed as Spark DataFrame plans.

Star lists, commit/change/blob tables and file contents go in; ranked
repositories, per-change commit records (author, language, churn) and
per-author symbol profiles come out.  Every operator takes and returns
DataFrames; nothing is collected to the driver.
"""

import sys as _sys

__version__ = "0.1.0"

# Functions that run in Python workers (mapInPandas / applyInPandas bodies, user
# functions defined here) are pickled by value, so executors need no installed copy
# of this package and no shared working directory.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle: rely on an installed package
    pass
