"""Logical planning helpers: matrices, sharding of hot keys, shared storage."""
