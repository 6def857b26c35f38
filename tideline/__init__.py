"""Monitoring of scored tables on Spark: profiles, drift metrics, alerts and model decisions."""
