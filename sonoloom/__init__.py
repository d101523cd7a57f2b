"""sonoloom: cine-clip and training-corpus analytics as PySpark DataFrame operators."""
