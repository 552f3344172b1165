"""Catalog snapshots and row profiles for fleets of databases, on Spark."""
