"""Image/caption data work as Spark DataFrame plans."""
