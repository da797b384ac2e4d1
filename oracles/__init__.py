"""Independent SQL for every query, used to check results."""
