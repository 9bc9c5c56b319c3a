"""Order-history analytics on Spark: standardise, mine, infer, retrieve, evaluate."""

import sys

from pyspark import cloudpickle

# Task kernels travel with the job, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
