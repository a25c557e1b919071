"""statloom: classic statistical-learning analytics as Spark DataFrame operators.

Every model is a table, training is a set of distributed aggregations (or a
short loop of them) and scoring is a join or a column expression.
"""

import sys

from pyspark import cloudpickle

# Functions sent to tasks travel by value: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
