"""Corpus preparation and hybrid retrieval as PySpark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with their code: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
