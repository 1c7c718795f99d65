"""Operators for preparing training data: quality, mixing, formatting, packing, search, deduplication."""

import sys

from pyspark import cloudpickle

# What runs in tasks travels with the job: executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
