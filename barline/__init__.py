"""Panel features, feature selection, forecast evaluation and blending on Spark.

A panel is a DataFrame with one row per ``(symbol, date)``.  Every operator takes and
returns DataFrames; nothing row-sized reaches the driver.
"""
