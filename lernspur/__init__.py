"""Learning analytics and corpus curation as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# functions sent to executors carry this package's code with them, so executors need no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
