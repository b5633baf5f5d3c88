"""Training-data operators: independent of the rest of the library."""
