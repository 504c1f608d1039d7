"""Training-data operators: one module per operator, queries and oracle SQL beside them."""
