"""Part of loredeck: sources."""
