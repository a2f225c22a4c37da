"""Training-data pipeline operators: one module for each, registered in ``queries``.

Nothing outside this subpackage imports it.
"""
