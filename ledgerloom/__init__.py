"""Financial question answering over text and tables as Spark DataFrame transforms."""

import sys

from pyspark import cloudpickle

from ledgerloom.config import EngineConfig

# The few Python functions that run inside tasks travel with the job, so workers
# need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["EngineConfig"]
