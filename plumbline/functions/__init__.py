"""Column functions: identity, version order, CVSS, risk, text."""
