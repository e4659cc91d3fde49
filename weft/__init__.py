"""weft: time-ordered merging and analysis of independent log sources on Spark."""
