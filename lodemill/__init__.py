"""lodemill: package-metadata and behavioural-corpus analytics written as Spark DataFrame jobs."""
