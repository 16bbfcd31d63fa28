"""fieldweave: Spark jobs for gridded agricultural weather and for text corpora."""
