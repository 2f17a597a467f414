"""Logical plans: the graph's tables and the projection of the test tables onto them."""
