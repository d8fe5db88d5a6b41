"""Set-oriented operators."""
