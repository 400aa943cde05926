"""Question-decomposition corpora and their evaluation, as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions which run in Python tasks travel with their code: workers need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
