"""tidemark: monthly snapshots of a business registry, their changes and the questions asked of them, on Spark."""
