"""riskloom: risk-factor analytics as Spark DataFrame operators.

Every operator takes and returns DataFrames; only small summaries (level
lists, term tables, p x p matrices, one-row results) reach the driver.
"""

import sys

from pyspark import cloudpickle

from riskloom.session import get_spark, scratch_dir

# Executors need no installed copy of this package: the few functions that run
# in Python workers (Arrow partial sums, the interval UDF) are shipped by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["get_spark", "scratch_dir"]
