"""Operators for training-data pipelines.

Nothing outside this folder imports it.  Each operator has a general interface
in its own module; :mod:`tidewell.llm.registry` holds the thin ``opN_*`` queries.
"""
