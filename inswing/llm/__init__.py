"""Operators for training-data pipelines over `documents`, `pages`, `benchmark`, `labels` and `conversations`.

Nothing outside this package imports it. Each module holds one operator; `queries` registers one query for each.
"""
