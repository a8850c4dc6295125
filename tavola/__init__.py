"""tavola: chain-operations analytics on Spark.

Every public operator takes DataFrames and returns a DataFrame; nothing in the
package keeps state outside Spark.
"""
