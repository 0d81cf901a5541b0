"""lodestone: knowledge retrieval and corpus processing on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors need no copy of the package: functions that run there travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
