"""Sensitive-data protection as Spark DataFrame, SQL and Structured Streaming jobs."""

import sys

from pyspark import cloudpickle

from cloakwork.session import checkpoint, configure, get_session

# The few Python helpers that run inside tasks travel with the task, so executors need no copy of
# the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["checkpoint", "configure", "get_session"]
