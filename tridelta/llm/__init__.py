"""Operators of a large-scale training-data pipeline (nothing else imports them).

The functions that run in Python workers are shipped by value, so executors
need only numpy, pyarrow, pandas and the tokenizer libraries installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
