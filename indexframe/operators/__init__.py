"""Collections and the operators on them."""
