"""Operators: functions from DataFrame(s) to DataFrame(s)."""
