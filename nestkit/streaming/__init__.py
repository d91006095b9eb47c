"""Unrolling of streams."""
