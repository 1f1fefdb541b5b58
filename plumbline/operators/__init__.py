"""Relational operators over packages, advisories, source facts and graphs."""
