"""Operators for preparing training data at scale.

Nothing else in :mod:`tagwise` imports this subpackage; remove the folder and the rest still works.
"""
