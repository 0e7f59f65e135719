"""shopsight: multi-tenant retail analytics on Spark DataFrames.

Sub-packages:
  sources    readers and writers (files, JDBC, report store, testdata adapters)
  functions  column expressions (hashing, order ids, formatting)
  operators  DataFrame -> DataFrame operators (cleaning, star upkeep, KPIs,
             RFM segmentation, basket mining, reports, advice)
  plans      whole jobs and the query catalog used by the driver
  streaming  micro-batch ingest with Structured Streaming
"""

__version__ = "0.1.0"
