"""A label-and-column dataframe engine expressed as lazy Spark plans."""

from __future__ import annotations

import sys

from pyspark.cloudpickle.cloudpickle import register_pickle_by_value

# Functions of this package travel to the executors by value, so that they need
# no copy of it on their path.
register_pickle_by_value(sys.modules[__name__])
