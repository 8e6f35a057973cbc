"""procura: a PySpark-native analytics engine for procurement line items."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Executors need no copy of this package: functions sent to them carry their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
