"""textgraph: trees of text files as a queryable graph, on Spark."""
