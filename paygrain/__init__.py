"""Card-payment analytics expressed as Spark DataFrame operators."""
