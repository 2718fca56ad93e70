"""Readers of access-log files and of network-block tables."""
