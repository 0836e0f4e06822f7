"""chainlens — supply-chain risk analytics as Spark DataFrame / Structured Streaming jobs.

Every operator takes a :class:`chainlens.sources.tables.Tables` bundle (lazy domain
DataFrames) and returns a DataFrame; nothing is collected to the driver.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

__version__ = "0.1.0"

# The few Python callbacks (the allocation fold, the state-machine processor) are
# shipped to executors by value, so workers need no installed copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
