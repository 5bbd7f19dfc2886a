"""quadrille: metrics, knowledge-graph and governance operators for PySpark.

Every operator is a function from DataFrames to a DataFrame. Nothing here runs
a job while a plan is being built, except the fixpoint operators in
``operators.traverse`` (they must look at the frontier) and the sinks.
"""

import sys

from pyspark import cloudpickle

# Python functions of this package travel to the executors with the tasks, so
# the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
