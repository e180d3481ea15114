"""Evidence-backed analytics as Spark DataFrame jobs."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

__version__ = "0.1.0"

# Python functions used in pandas UDFs travel with the job, so executors do
# not need this package installed.
register_pickle_by_value(sys.modules[__name__])
