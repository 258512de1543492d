"""gleanery: Spark jobs that decide which records of a large collection are redundant."""
