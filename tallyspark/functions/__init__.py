"""Column expressions.  Nothing in here triggers a job or needs a Python worker."""
