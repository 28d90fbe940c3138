"""Operators for building training data: each works on whole tables and keeps whole results."""
