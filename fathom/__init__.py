"""fathom: semantic retrieval, knowledge-graph and bi-temporal analytics expressed as Spark DataFrame plans."""
