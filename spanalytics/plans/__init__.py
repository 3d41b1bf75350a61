"""Whole queries: the catalogue, its SQL twins, the report and the API."""
