"""tidelog: time-series log analytics as Spark plans.

``schema``      canonical rows, limits and settings
``functions``   column functions: labels, literals, formats, comparison rules
``operators``   DataFrame -> DataFrame: series, labels, metrics, comparison, validation
``sources``     table adapters, the file store, wire frames, run results
``streaming``   micro-batch ingestion
``plans``       the registered queries and their SQL
"""
