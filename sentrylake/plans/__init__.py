"""End-to-end plans and the rulebook."""
