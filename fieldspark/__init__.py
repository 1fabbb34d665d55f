"""Linear inverse modelling of gridded time series on Spark.

A *field* is a DataFrame ``(t long, cell long, value double)``; missing values are NULL. A *grid* is a DataFrame
``(cell, lat, lon, cell_area)``. Operators take and return such DataFrames, so plans stay lazy and compose.
"""
