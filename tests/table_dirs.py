"""Folders of the given tables that the tests read."""

SMALL = "/root/testdata/sf0.001"
