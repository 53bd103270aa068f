"""Clinical time-series cohort and feature engine on Spark DataFrames."""
