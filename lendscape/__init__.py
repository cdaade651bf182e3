"""Credit-snapshot analytics on Spark: typed layers, labels, features, scoring and monitoring."""
