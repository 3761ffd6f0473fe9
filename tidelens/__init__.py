"""Time series, networks and Markov dynamics as lazy DataFrame-to-DataFrame operators on Spark.

Frame kinds (all long form): field ``(t, node, value)``, matrix ``(i, j, w)``,
vector ``(node, p)`` and membership ``(node, com)``.
"""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
