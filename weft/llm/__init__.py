"""Operators of a training-data pipeline, built on Spark DataFrames.

Nothing outside this folder imports it. Functions that run in Python workers
travel by value, so a cluster needs no installed copy of this package.
"""

import weft
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(weft)
