"""graphloom: knowledge-graph QA analytics on PySpark DataFrames."""
