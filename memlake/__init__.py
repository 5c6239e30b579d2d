"""memlake: retrieval, curation, outcome analytics and merging over record corpora, as Spark DataFrame operators."""
