"""Training-data operators: decontamination, quality, language models, mixing, joins, sharding, and more.

Nothing outside this subpackage imports it.
"""
