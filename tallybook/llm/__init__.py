"""Operators for training-data pipelines: dedup, filtering, mixing, output.

Nothing else in the library imports this subpackage. Its functions travel to
the executors with the job, so that only the driver needs the code.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
