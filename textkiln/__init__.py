"""A Spark engine that compacts and analyses line-oriented text."""
