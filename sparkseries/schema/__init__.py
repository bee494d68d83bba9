"""Schemas: define, validate, infer, merge, compare, evolve, migrate, export."""
