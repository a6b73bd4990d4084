"""Mining operators."""
