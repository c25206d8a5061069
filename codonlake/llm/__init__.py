"""Training-data operators: ten text operators that run as Spark jobs over whole tables."""
