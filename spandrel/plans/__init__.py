"""Logical plans that several outputs share."""
