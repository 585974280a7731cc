"""Part of loredeck: streaming."""
