"""storeflow: store-activity analytics on Spark DataFrames.

Every operator is ``f(df, *dims, **params) -> DataFrame``; plans compose operators into reports.
"""
