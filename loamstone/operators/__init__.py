"""Relational operators: scans, candidate legs, fusion, mutation and views."""
