"""topicflow: content-stream analytics on Spark."""

import sys

from pyspark import cloudpickle

# functions sent to executors carry their code with them, so nothing needs installing there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
