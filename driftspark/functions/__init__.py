"""Column expressions: text and path rules, type classes, error records."""
