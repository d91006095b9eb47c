"""Inputs: tables of a folder, and nested values built from them."""
