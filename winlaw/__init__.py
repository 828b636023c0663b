"""Window-law analytics and corpus preparation, expressed as Spark plans.

The package ships its functions to Python workers by value, so a session whose
workers cannot import it (a notebook, a driver started elsewhere) still runs.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

cloudpickle.register_pickle_by_value(sys.modules[__name__])
