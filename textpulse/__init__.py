"""textpulse: review-text analytics and model monitoring on Spark.

Every operator is a DataFrame -> DataFrame (or Column -> Column) function so
Catalyst sees one declarative plan; Python is used only for a few small
per-batch helpers (Arrow pandas UDFs) and for driver-side decisions on one-row
results.
"""

__version__ = "0.1.0"
