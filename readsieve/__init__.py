"""Spark-native duplicate marking for sequencing alignments, and a training-data toolbox in :mod:`readsieve.llm`."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
