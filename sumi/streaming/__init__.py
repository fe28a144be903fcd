"""The batch stages over arriving files."""
