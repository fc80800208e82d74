"""Domain-splitting average linkage of one connected component; plain Python, no Spark."""
