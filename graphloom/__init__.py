"""Code-graph analytics on PySpark."""

import sys

from pyspark import cloudpickle

# functions that run on executors travel with the jobs, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
