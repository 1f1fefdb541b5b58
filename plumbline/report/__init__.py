"""Report sinks: JSON, SARIF, OpenVEX, CycloneDX and a terminal table."""
