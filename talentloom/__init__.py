"""Recruitment analytics on Spark: search, dashboards, résumé parsing and match scoring."""
