"""stayline: longitudinal cohort analytics as plain Spark DataFrame operators.

Layout
------
* ``stayline.sources``   - table loading / writing, schemas, column profiles
* ``stayline.functions`` - column expressions (scalars, scores, links) and fixed values
* ``stayline.operators`` - DataFrame -> DataFrame operators (stays, grid, windows,
  joins, quality, codes, preparation, evaluation)
* ``stayline.plans``     - clinical compositions and the query catalogue used by
  the driver contract (``__spark_entry__.py``)
* ``stayline.streaming`` - intentionally empty: the reference is batch only
"""

from stayline.session import get_spark, checkpoint_dir, cut_lineage  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir", "cut_lineage"]
