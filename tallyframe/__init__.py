"""Reconcile, profile, analyse and load tables on Spark."""
