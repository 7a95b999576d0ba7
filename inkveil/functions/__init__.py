"""Functions of the library; see the README for the inventory."""
