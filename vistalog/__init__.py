"""Scene-quality analytics over multi-channel sensor logs, as Spark DataFrames."""
