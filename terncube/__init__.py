"""terncube: PySpark operators for multi-scale probability cubes."""
