"""textsignal — leak-safe text + market feature pipelines on Spark DataFrames.

Every public function takes and returns a ``pyspark.sql.DataFrame`` keyed by
``(asset, date)``; nothing is collected to the driver except tiny
configuration values (manifests, model coefficients).
"""

from textsignal.session import get_spark, ensure_checkpoint_dir

__all__ = ["get_spark", "ensure_checkpoint_dir"]
