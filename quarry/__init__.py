"""quarry: snapshot and corpus analytics expressed as Spark DataFrame plans.

Every public operator takes DataFrames (plus plain Python options) and returns a
DataFrame. Nothing is collected to the driver except tiny rule tables and loop
control counters.
"""

from quarry.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
