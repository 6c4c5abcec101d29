"""The registered queries, the tables they see, and their SQL counterparts."""
