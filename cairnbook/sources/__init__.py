"""Scans of exports into one item shape. Each takes a glob over many exports and parses inside the executors."""
