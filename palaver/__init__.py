"""Discussion-thread analytics on Spark DataFrames.

Pages of a thread go in, one row per post comes out, and every statistic is a
function from DataFrame to DataFrame.
"""
