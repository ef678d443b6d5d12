"""Queries that apply the operators to the driver's tables, with the SQL that checks them."""
