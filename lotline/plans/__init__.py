"""The reports: functions from input tables to one result table."""
