"""Column builders: no Python runs on the executors."""
