"""Part of loredeck: operators."""
