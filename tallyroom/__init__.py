"""Evidence-gated filing analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Python functions travel to the executors inside their task, so the package
# need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
