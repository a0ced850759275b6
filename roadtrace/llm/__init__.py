"""Training-data operators: each module is one operator with a DataFrame interface.

``queries.py`` registers the thin contract queries; nothing outside this
subpackage imports it.
"""
