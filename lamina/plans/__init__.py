"""The store and the queries."""
