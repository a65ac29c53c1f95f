"""Temporal rule analytics on Spark."""
