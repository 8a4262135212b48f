"""moltide: molecular-dynamics trajectory analytics as PySpark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions of this package go to the workers by value: executors need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
