"""Spark-first dataset triage: profile, detectors, evidence and ranked work items."""
