"""Derived inputs and command lines."""
