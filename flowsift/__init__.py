"""Flow features, clustering and outlier scoring as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Block kernels travel with their tasks, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
