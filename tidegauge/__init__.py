"""Time-series feature, label, alarm and evaluation operators as Spark DataFrames."""
