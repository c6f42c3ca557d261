"""Column functions and the helpers shared by the operators."""
