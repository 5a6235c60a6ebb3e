"""Column functions shared by the operators, and the registry of named features and statistics."""
