"""A rule and table analytics engine on Spark DataFrames."""
