"""Readers of quantification, matrix, cohort and log files into long tables."""
