"""Part of graintable."""
