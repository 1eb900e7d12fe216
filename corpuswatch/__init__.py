"""Article and event-stream analytics as Spark DataFrame operators."""
