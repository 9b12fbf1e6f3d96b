"""Column functions: nothing here runs a job or needs a shuffle."""
