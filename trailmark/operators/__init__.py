"""User-facing operators on canonical flow and anchor frames."""
