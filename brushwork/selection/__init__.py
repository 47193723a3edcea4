"""Selections: brushes, lassos, series tests and their predicates and degrees."""
