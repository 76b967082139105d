"""netsieve: network-flow telemetry analytics and flood detection on Spark.

Every public operator takes and returns a ``pyspark.sql.DataFrame``; thresholds,
topology and clocks are arguments, never process globals.
"""

from netsieve.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
__version__ = "0.1.0"
