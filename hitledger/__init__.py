"""Web-access-log analytics on Spark: raw request lines in, daily and hourly rollups and traffic answers out."""
