"""Family-aware genetics on Spark: calling, refinement and the data work around them."""
