"""Search plans and their parameters."""
