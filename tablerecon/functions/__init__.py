"""Part of the reconciliation library."""
