"""What is decided before a Spark plan is made."""
