"""Folders of the given tables."""

SMALL, CHECKED = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
