"""Derived views over the driver tables, registered queries and their SQL twins."""
