"""Registered queries: each module holds thin queries over the test tables and their SQL."""
