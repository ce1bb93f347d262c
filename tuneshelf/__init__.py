"""tuneshelf: catalogue retrieval and ranking as Spark DataFrame jobs."""

import sys as _sys

try:  # ship task-side Python (cogroup / mapInPandas functions) by value to the workers
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older pyspark without the hook
    pass
