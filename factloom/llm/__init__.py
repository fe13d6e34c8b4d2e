"""Operators on free text; nothing outside this subpackage imports it."""
