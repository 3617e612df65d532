"""servebench: Spark-native analytics for LLM-serving benchmark data.

Every operator is a ``DataFrame -> DataFrame`` function built on Spark's own
expressions; nothing is collected to the driver inside an operator.
"""

__version__ = "0.1.0"
