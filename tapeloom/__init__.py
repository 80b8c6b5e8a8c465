"""Trading-telemetry analytics expressed as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel by value, so that workers (also the helper process of
# keyed stream processors) need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
