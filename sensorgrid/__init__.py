"""Sensor-network time series on Spark DataFrames.

Layout
------
functions   Column expressions (parsing, time, geometry, kernels)
sources     readers and writers
operators   DataFrame -> DataFrame building blocks
model       sparse Gaussian process whose statistics are summed on executors
plans       user-level jobs composed of the above
streaming   the same operators on Structured Streaming
catalog     registered queries over the driver's tables, with oracle SQL
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run on executors travel with their code, so executors need not have
# the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
