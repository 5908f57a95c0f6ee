"""Operators for training-data pipelines, built on Spark jobs and, inside tasks, numpy over Arrow batches."""

import sys

from pyspark import cloudpickle

# Executors need not have this package: what runs in tasks is sent with them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
