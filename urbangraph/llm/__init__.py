"""Operators for preparing language-model training corpora (nothing outside this subpackage imports it)."""
