"""Part of catsim."""
