"""Definitions of reports, the engine that shows them as views, and the registered queries."""
