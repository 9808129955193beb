"""DataFrame-in, DataFrame-out operators built on the column expressions."""
