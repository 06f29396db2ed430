"""Report catalogue, registry and SQL oracle."""
