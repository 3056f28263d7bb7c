"""Relational operators with the semantics of catalogs, crosswalks and plans."""
