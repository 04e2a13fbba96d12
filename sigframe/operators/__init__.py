"""Relational operators over (date, entity) panels."""
