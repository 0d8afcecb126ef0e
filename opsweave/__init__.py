"""Operations, policy and code-graph analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions run in tasks travel with their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
