"""Training-data operators. Nothing outside this package imports it, but for the registry hook of the entry file."""
