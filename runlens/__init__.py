"""Run-quality analytics as Spark DataFrame plans."""
