"""End-to-end plans over the sample tables: derived inputs, queries and their SQL."""
