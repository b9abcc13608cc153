"""keyloom: keyed, expiring state and command-log analytics on PySpark.

Python functions that run on executors are pickled by value, so executors need
not have the package installed.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

cloudpickle.register_pickle_by_value(sys.modules[__name__])
