"""quiverlake: vector search and corpus processing as Spark DataFrame plans."""
