"""waygraph: spatial-graph analytics as DataFrame-in, DataFrame-out Spark jobs."""
