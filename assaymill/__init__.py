"""assaymill: document-derived scientific tables on Spark.

``functions`` are Column expressions, ``operators`` DataFrame transformations,
``sources`` readers and writers, ``plans`` whole queries, ``streaming`` their
incremental forms."""
