"""muonloom: air-shower event analytics as PySpark DataFrame operators."""
