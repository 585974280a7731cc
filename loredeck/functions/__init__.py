"""Part of loredeck: functions."""
