"""Procurement-notice analytics on Spark: normalise, resolve, classify, match, report and forecast over DataFrames of any size."""
