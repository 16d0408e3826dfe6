"""Operators for preparing large text corpora. Nothing outside this folder imports it; see ``queries`` for the registered queries."""
