"""Columns and tables that reviews come from and go to."""
