"""Spark jobs over tables and streams of language-model generations.

``functions``  native column expressions (text, answers, rewards)
``operators``  DataFrame -> DataFrame operators
``sources``    readers and writers
``streaming``  Structured Streaming versions
``plans``      registered queries, their derived inputs and their SQL checks
"""

import sys

from pyspark import cloudpickle

# Python functions of this package travel to executors by value, which need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
