"""chronofold: bitemporal, evidence-backed analytics as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions go to the executors by value, so only the driver needs the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
