"""tabflow: feature preparation and model scoring for tabular data, as Spark DataFrame code."""

import sys

from pyspark import cloudpickle

# The few Python functions that run inside tasks travel with the job, so that executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
