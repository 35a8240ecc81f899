"""Security-log analytics and corpus preparation on Apache Spark."""
