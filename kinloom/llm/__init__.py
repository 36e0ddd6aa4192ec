"""Training-data operators: one module for each, each with a general interface and a thin query."""
