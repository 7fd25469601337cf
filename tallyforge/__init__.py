"""Forensic analysis of project-finance documents, as DataFrame operators on Spark."""
