"""Operators on findings, labels, events and sites: functions from DataFrames to DataFrames."""
