"""Spark-native analytics for text-regression experiments.

sources    readers, writers and the table views every study starts from
functions  Column -> Column expressions (text, formatting, hashing, tails)
operators  DataFrame -> DataFrame operators (ranking, variance, grids, tests)
plans      whole studies and the catalogue of named queries with their SQL
streaming  run-log intake as Structured Streaming jobs
"""

import sys

from pyspark import cloudpickle

# functions that run in tasks travel with their code, so executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
