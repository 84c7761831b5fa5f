"""Whole jobs built from the operators: refresh, reports and the query catalog."""
