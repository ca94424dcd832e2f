"""Plan helpers: staged tables that cut lineage, and joins with a checked broadcast."""
