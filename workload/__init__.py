"""The registered queries: an access log derived from the supplied tables, and SQL twins of every answer."""
