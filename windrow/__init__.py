"""windrow: flow-window dataset jobs on Spark DataFrames."""
