"""veinmap: ontology-driven knowledge extraction on PySpark DataFrames."""
