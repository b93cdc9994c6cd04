"""Document-corpus and ledger analytics, written as Spark DataFrame operators.

Every public operator takes DataFrames (or Columns) and returns DataFrames (or
Columns); nothing here runs an action on its own.
"""

import sys

from pyspark import cloudpickle

from quirework.config import Settings

# The few Python functions that run in tasks travel by value, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Settings"]
