"""guideloom: guide-RNA off-target analytics and training-data operators on PySpark."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with their code, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
