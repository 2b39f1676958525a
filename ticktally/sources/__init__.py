"""Datagrams, JSON spellings, UDP, and tables as request sources."""
