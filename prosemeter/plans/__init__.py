"""The catalogue of queries: each operator applied to the tables, and the same in SQL."""
