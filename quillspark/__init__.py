"""Document conversion and document analytics on Spark."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: what its functions refer to travels with them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
