"""Key orders, merge rules and small column functions."""
