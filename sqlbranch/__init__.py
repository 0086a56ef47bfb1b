"""A Spark-native analytics engine for relational data in versioned, branchable workspaces."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code along, so that only the driver needs this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
