"""Contract-driven table reconciliation on Spark."""
