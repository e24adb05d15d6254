"""Graph, flow, search and risk analytics on PySpark."""
