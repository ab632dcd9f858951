"""tierlens: Spark-native analytics for cost-aware routing of language-model requests.

Every operator is a function ``DataFrame -> DataFrame`` (or a column expression
builder) made of built-in Spark SQL functions, ``pyspark.ml`` and Structured
Streaming.  Nothing is collected to the driver.
"""

__version__ = "0.1.0"
