"""Inputs: a registry of connectors that give lazy DataFrames."""

from .connectors import Connection, introspect, read, test

__all__ = ["Connection", "introspect", "read", "test"]
