"""sweepframe: inspection-pass analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions handed to Python workers travel with the job; executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
