"""Stages and jobs, as functions from DataFrame to DataFrame."""
