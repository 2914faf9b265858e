"""corpusgraph: document corpora as queryable knowledge graphs on PySpark."""
