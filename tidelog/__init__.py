"""tidelog: versioned key-value analytics and corpus preparation on Spark."""
