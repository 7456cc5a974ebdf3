"""Job-posting analytics on Spark: extract, deduplicate, match, classify, summarise."""

import sys

from pyspark import cloudpickle

# The small helpers that run in tasks travel with the plan, so executors need
# no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
