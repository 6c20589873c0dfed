"""Operators for large training-data pipelines, one module each; nothing outside this subpackage imports them."""
