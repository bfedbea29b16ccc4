"""Training-data operators: packing, extraction, decontamination, scoring, scanning, joins, output.

Nothing else in the library imports this subpackage.  ``queries.py`` holds the
thin contract queries that ``__spark_entry__`` registers when this package exists.
"""
