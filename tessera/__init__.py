"""Tessera: DataFrame operators that reconcile many imperfect observations of the same items."""
