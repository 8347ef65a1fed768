"""Operators that prepare text for training language models.

Each module holds one operator: a function from DataFrames to a DataFrame, with the
parameters it needs. ``queries`` applies each to its whole table. Nothing outside this
package imports it.
"""

import sys

from pyspark import cloudpickle

# Code of tasks travels with them, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
