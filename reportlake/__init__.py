"""reportlake: security-report analytics as Spark DataFrame operators.

Every operator takes and returns DataFrames. Frame operators accept
``keys`` so one job answers for every customer / zone / template at once;
``keys=()`` gives the single-frame answer.
"""

from reportlake.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
