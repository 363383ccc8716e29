"""PySpark operators for positioning and geospatial evaluation data."""
