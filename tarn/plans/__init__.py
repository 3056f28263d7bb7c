"""Compositions: catalogs, fetch plans, harmonized observations, named graph queries."""
