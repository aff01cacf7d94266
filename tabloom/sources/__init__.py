"""Workbook readers and writers."""
