"""textloom: text analytics as Spark DataFrame plans."""
