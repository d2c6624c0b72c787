"""cairn: dataset analyses as Spark DataFrame operators."""
