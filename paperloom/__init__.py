"""Document-intake analytics and training-data operators on Apache Spark."""
