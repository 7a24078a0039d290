"""Unit-economics analytics on PySpark.

Layout: ``sources`` reads and normalises the three logical tables, ``functions``
holds column expressions, ``operators`` holds table-agnostic DataFrame steps and
``plans`` holds the named queries composed from them.
"""
