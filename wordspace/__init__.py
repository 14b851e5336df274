"""Random-indexing text analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Arrow helpers travel to the executors inside the plan, so a cluster needs no
# extra package distribution step.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
