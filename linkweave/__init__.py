"""Entity-link and ring analytics expressed as Spark DataFrame operators."""
