"""desense: sensitive-data masking and corpus preparation as Spark jobs."""
