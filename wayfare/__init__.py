"""wayfare: customer-journey analytics as plain Spark DataFrame functions."""
