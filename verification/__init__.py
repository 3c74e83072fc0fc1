"""Registered queries and the SQL that checks them."""
