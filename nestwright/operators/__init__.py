"""Operators on tables: nesting joins, quality rules, profiles, shapes, synthetic rows."""
