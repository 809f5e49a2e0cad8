"""Operators for preparing large text and web corpora. Nothing outside this subpackage imports it."""
