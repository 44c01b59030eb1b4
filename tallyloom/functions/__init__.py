"""Column functions: text as the log viewers count it, time on explicit axes, money in integers."""
