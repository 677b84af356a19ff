"""Point-cloud analytics and corpus preparation as PySpark programs."""

import sys

from pyspark import cloudpickle

# Functions for the executors travel with their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
