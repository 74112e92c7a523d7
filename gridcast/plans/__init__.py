"""Query registry: end-to-end plans over the test tables, each beside its SQL twin."""
