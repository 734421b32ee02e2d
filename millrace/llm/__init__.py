"""Operators for training-data pipelines; nothing else in the library imports this."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code, so nothing needs installing there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
