"""The registered queries: inputs derived from the supplied tables, and their SQL counterparts."""
