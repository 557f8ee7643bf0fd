"""Graph operators over node and edge tables."""
