"""Timeline analytics on PySpark: DataFrame operators for pooled, multi-contributor event timelines.

Modules are pickled by value, so that Python workers need no copy of the repository on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
