"""Training-data operators for web-scale text, vectors and pages.

Nothing outside this subpackage imports it; ``queries.QUERIES`` and
``queries.ORACLE_SQL`` list what the driver registers.
"""
