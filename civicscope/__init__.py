"""Location and market analytics as parameterised PySpark DataFrame operators."""
