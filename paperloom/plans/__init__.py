"""Plans over the given tables, and helpers that stage intermediate tables."""
