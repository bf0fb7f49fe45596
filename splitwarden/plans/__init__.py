"""Specifications compiled to DataFrame plans."""
