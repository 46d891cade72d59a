"""Column functions: constants, text algebra and metrics."""
