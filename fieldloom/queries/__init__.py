"""The registered queries: ``QUERIES`` and ``SQL`` of each module."""
