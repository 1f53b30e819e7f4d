"""tablescope: profile, judge, clean, augment, chart and search tables with Spark."""

import sys

from pyspark import cloudpickle

# Code that runs inside tasks travels with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
