"""Readers for the record files the operators work on, and writers for the reports."""
