"""The registered queries, their SQL and the end-to-end preparation."""
