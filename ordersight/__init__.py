"""Order-satisfaction analytics on Spark: cleaning, as-of features, hierarchical classification over time."""
