"""Evidence analytics on Spark: signals, reviews, clusters, scores and gates as DataFrame operators."""
