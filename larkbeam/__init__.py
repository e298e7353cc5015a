"""larkbeam: analytics on tables and streams, written for Spark."""

import sys

from pyspark import cloudpickle

from larkbeam.session import local_session, scratch_path
from larkbeam.sources.tables import register_views, table

__all__ = ["local_session", "register_views", "scratch_path", "table"]

# executors then need no copy of this package to run its Python functions
cloudpickle.register_pickle_by_value(sys.modules[__name__])
