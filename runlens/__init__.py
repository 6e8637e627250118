"""Compare ensembles of estimated runs with their ground truth on Spark."""
