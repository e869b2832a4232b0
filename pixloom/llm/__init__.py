"""Operators for large text collections: filtering, matching, scoring, rendering.

Each module holds one operator with a general interface; ``queries`` applies
them to the driver's tables and ``queries.ORACLES`` has the SQL equivalents.
Nothing outside this subpackage imports it.
"""
