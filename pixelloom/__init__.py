"""pixelloom: gridded-observation analytics as PySpark DataFrame operators.

Rasters are long pixel tables, every operator is a function from DataFrame to
DataFrame, and a missing value is always NULL (never NaN or a sentinel).
"""

from pixelloom.grid import GridSpec, grid_offset

__all__ = ["GridSpec", "grid_offset"]
