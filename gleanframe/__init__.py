"""Table hygiene and automated analysis as Spark DataFrame operators."""
