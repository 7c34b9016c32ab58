"""embertrace: detection, alert correlation and entity risk as PySpark jobs."""

import sys

from pyspark import cloudpickle

from embertrace.config import EngineConfig

# Python tasks carry their functions with them, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["EngineConfig"]
