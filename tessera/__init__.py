"""Retrieval, mining, memory, evaluation and corpus analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with the task, which need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
