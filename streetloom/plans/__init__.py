"""How metrics are ordered, and how intermediate tables are kept."""
