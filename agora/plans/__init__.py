"""Composite jobs: daily analytics, batch tables, weekly report, ETL and model runs."""
