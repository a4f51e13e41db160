"""strataq: question answering, quantity and nested-record analytics over regulatory text on Spark.

Every operator takes and returns DataFrames. The driver only ever sees constants, sizes and schemas.
"""

__version__ = "0.1.0"
