"""Training-data operators: one module per operator, each with its query."""
