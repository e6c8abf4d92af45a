"""Analytics over building-model tables on Spark.

``sources`` scans and writes layers, ``functions`` are scalar expressions, ``operators`` map DataFrames to DataFrames,
``plans`` is the catalogue of queries over the driver's tables, ``streaming`` the incremental upsert.
"""
