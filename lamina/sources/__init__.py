"""Files and their formats."""
