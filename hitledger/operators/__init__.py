"""DataFrame-to-DataFrame steps: parse, roll up, rank, locate, compare with the ledger."""
