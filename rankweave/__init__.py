"""rankweave: dataset-level PySpark operators for retrieval, ranking, evaluation,
weekly state tables and response telemetry.  DataFrame in, DataFrame out."""

__version__ = "0.1.0"
