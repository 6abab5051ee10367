"""barloom package."""
