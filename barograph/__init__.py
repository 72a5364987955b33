"""Panel market analytics expressed as PySpark DataFrame operators."""
