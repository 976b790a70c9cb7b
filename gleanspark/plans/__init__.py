"""Whole analyses, their configuration, and the registered queries."""
