"""Queries over the standard tables, and the SQL that checks them."""
