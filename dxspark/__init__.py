"""dxspark: coded-clinical-record analytics as Spark DataFrame jobs.

Every public function takes DataFrames (and column names / parameters) and
returns a DataFrame. Nothing is collected to the driver except bounded
parameter lists (thresholds, quantile cut points, grids).
"""

from dxspark.session import get_spark, scratch_path

__all__ = ["get_spark", "scratch_path"]
