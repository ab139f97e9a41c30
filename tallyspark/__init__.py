"""Reconciliation of tables and change reports over definition catalogs, as Spark jobs."""
