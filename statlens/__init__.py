"""statlens: statistical table analysis as Spark DataFrame operators."""
