"""Whole plans: a bibliography derived from the star schema, the manuscript pipeline, and the registered queries."""
