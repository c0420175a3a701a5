"""churnlens: release-diff and findings analytics as Spark DataFrame operators."""

import sys as _sys

__version__ = "0.1.0"

# Ship this package's code with the Python functions it hands to Spark
# (pandas UDFs, mapInPandas, applyInPandasWithState) instead of requiring
# it to be installed on every executor.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - pyspark without cloudpickle
    pass
