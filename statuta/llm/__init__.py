"""Training-data operators: ten corpus-scale jobs on DataFrames, each in its own module."""
