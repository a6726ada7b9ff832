"""tagmill: label large text tables from a small labelled seed, on Spark."""
