"""NumPy kernels, without Spark: they ship to executors and are tested alone."""
