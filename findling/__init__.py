"""Multi-tenant document retrieval expressed as PySpark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Batch functions travel to the executors with their code, so a cluster needs no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
