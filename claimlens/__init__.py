"""claimlens: claims analytics as Spark DataFrame jobs.

Every public function takes and returns DataFrames (or small dicts of them);
all heavy work is planned by Catalyst and runs on the executors.
"""

import sys as _sys

__version__ = "0.1.0"

# Python functions shipped to executors (pandas UDF bodies) are pickled by
# value, so executors need no installed copy of this package.
try:  # pragma: no cover - depends on the pyspark build
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass
