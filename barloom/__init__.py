"""barloom: market-bar analytics as Spark DataFrame plans."""
