"""threadmetrics: Spark-native analytics over threaded online discussions.

Every operator is a function ``DataFrame -> DataFrame`` built from the
DataFrame API, SQL functions and ``pyspark.ml``; Catalyst sees one plan
until a write or a checkpoint.
"""

__version__ = "0.1.0"
